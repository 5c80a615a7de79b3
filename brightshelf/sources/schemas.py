"""Fixed schemas and value sets."""

from __future__ import annotations

# The event types the platform accepts.
EVENT_TYPES = [
    "view",
    "click",
    "search",
    "add_to_cart",
    "purchase",
    "like",
    "wishlist",
    "impression",
]

# Time-decay popularity weight per event type; any other type weighs 1.0.
EVENT_TYPE_WEIGHTS = {
    "purchase": 3.0,
    "add_to_cart": 2.0,
    "view": 1.0,
    "click": 1.5,
    "like": 1.0,
    "wishlist": 1.0,
    "search": 0.5,
    "impression": 0.1,
}

# Events that make a training row positive.
POSITIVE_EVENTS = ["purchase", "add_to_cart"]

# One interaction as the library uses it.
INTERACTION_DDL = (
    "event_id bigint, user_id bigint, item_id bigint, event_type string, ts timestamp, value double"
)

# One JSON event message as it travels on a topic or lies in the lake (epoch seconds).
MESSAGE_DDL = (
    "event_id string, event_type string, product_id string, user_id string, "
    "timestamp bigint, quantity int, price double"
)

# Tables of the test data set, read with explicit types so filters reach the scan.
TABLE_DDL = {
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}
