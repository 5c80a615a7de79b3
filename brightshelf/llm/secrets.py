"""Secret scan: all rules in one automaton, one pass over the bytes of a text.

The automaton tells which rules have a match in a text; only there the rule's own regex gives the
exact spans (leftmost, not overlapping within a kind).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brightshelf.llm.automaton import Automaton, compile_rules, scan
from brightshelf.llm.frames import TEXT, scan_text
from brightshelf.llm.words import code_points


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: bytes  # exact span; group "v", if there is one, must have `least` bytes, else the span
    least: int
    trigger: bytes  # what the automaton looks for: occurs in every text with a span that is kept
    bounded: bool = False  # starts only where no letter, digit or underscore stands before


_KEY = rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
BASE = [
    Rule("assign", _KEY + rb"(?P<v>[A-Za-z0-9+/_.=-]+)", 6, _KEY + rb"[A-Za-z0-9+/_.=-]"),
    Rule("access", rb"AKIA[A-Z0-9]+", 20, rb"AKIA[A-Z0-9]"),
    Rule("hex", rb"[0-9a-f]+", 24, rb"[0-9a-f]{24}"),
]

_LOGIN = rb"(?:https?|ftps?|postgres(?:ql)?|mysql|mongodb|rediss?|amqps?)(?:\+[a-z0-9]+)?://"
_PASSWORD = rb"[A-Za-z0-9._~%!$&'()*+,;=:-]"  # what RFC 3986 allows there
_KEY_NAME = rb"(?:(?:RSA|DSA|EC|OPENSSH|PGP|ENCRYPTED) )?PRIVATE KEY(?: BLOCK)?-----"
_KEY_LINE = rb"(?:(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):[^\r\n]*|[A-Za-z0-9+/=]+(?=[\x20\t]*(?:[\r\n\\\"']|\Z)))"
# A private key ends at its END line; one cut off before it, with its last line of headers or base64.
_KEY_TAIL = (
    rb"(?:(?:[^-]|-(?!----))*-----END " + _KEY_NAME
    + rb"|(?:(?:[\x20\t]*(?:\r\n|[\r\n]|\\r|\\n))+[\x20\t>|#*]*" + _KEY_LINE + rb"|[\x20\t]+[A-Za-z0-9+/=]{16,})*)"
)

# Publicly documented token formats: kind, prefix, body set, least body length.
FORMATS: list[tuple[str, bytes, bytes, int]] = [
    ("github", rb"gh[pousr]_", rb"[A-Za-z0-9]", 30),
    ("github-fine", rb"github_pat_", rb"[A-Za-z0-9_]", 30),
    ("gitlab", rb"glpat-", rb"[A-Za-z0-9_-]", 20),
    ("slack", rb"xox[abprs]-", rb"[A-Za-z0-9-]", 20),
    ("slack-app", rb"xapp-[0-9]-", rb"[A-Za-z0-9-]", 20),
    ("slack-hook", rb"hooks\.slack\.com/services/", rb"[A-Za-z0-9/]", 20),
    ("google-api", rb"AIza", rb"[A-Za-z0-9_-]", 35),
    ("google-oauth", rb"ya29\.", rb"[A-Za-z0-9_-]", 30),
    ("stripe", rb"[sr]k_(?:live|test)_", rb"[A-Za-z0-9]", 20),
    ("stripe-hook", rb"whsec_", rb"[A-Za-z0-9]", 30),
    ("sendgrid", rb"SG\.", rb"[A-Za-z0-9_.-]", 40),
    ("npm", rb"npm_", rb"[A-Za-z0-9]", 30),
    ("pypi", rb"pypi-", rb"[A-Za-z0-9_-]", 40),
    ("telegram", rb"[0-9]{8,10}:AA", rb"[A-Za-z0-9_-]", 30),
    ("square", rb"sq0(?:atp|csp)-", rb"[A-Za-z0-9_-]", 22),
    ("shopify", rb"shp(?:at|ca|pa|ss)_", rb"[A-Fa-f0-9]", 32),
    ("digitalocean", rb"do[opr]_v1_", rb"[a-f0-9]", 40),
    ("dockerhub", rb"dckr_pat_", rb"[A-Za-z0-9_-]", 20),
    ("databricks", rb"dapi", rb"[a-f0-9]", 32),
    ("huggingface", rb"hf_", rb"[A-Za-z0-9]", 30),
    ("openai", rb"sk-(?:proj-)?", rb"[A-Za-z0-9_-]", 40),
    ("linear", rb"lin_api_", rb"[A-Za-z0-9]", 30),
    ("postman", rb"PMAK-", rb"[a-f0-9-]", 30),
    ("twilio", rb"(?:SK|AC)", rb"[a-f0-9]", 32),
    ("mailgun", rb"key-", rb"[a-f0-9]", 32),
    ("aws-temporary", rb"ASIA", rb"[A-Z0-9]", 16),
    ("jwt", rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ", rb"[A-Za-z0-9_.-]", 16),
    ("bearer", rb"(?i:authorization: *bearer) +", rb"[A-Za-z0-9_.=/+-]", 20),
    ("basic-auth-url", _LOGIN + rb"[A-Za-z0-9._%+~-]+:" + _PASSWORD + rb"{3,}@", rb"[A-Za-z0-9.-]", 3),
    ("private-key", rb"-----BEGIN " + _KEY_NAME, b"", 0),
]

# Looser triggers of formats whose prefix has counters of its own.
TRIGGERS = {
    "telegram": rb"[0-9]+:AA",
    "jwt": rb"eyJ[A-Za-z0-9_-]+\.eyJ",
    "basic-auth-url": _LOGIN + rb"[A-Za-z0-9._%+~-]+:" + _PASSWORD + rb"+@",
}
TAILS = {"private-key": _KEY_TAIL}


def secret_rules() -> list[Rule]:
    """Base kinds first, then the published formats; positions give the order among equal starts."""
    rules = list(BASE)
    for kind, prefix, body, least in FORMATS:
        count = str(least).encode()
        # Counters of overlapping bodies multiply states, so the automaton looks for the prefix and
        # one body byte; the exact regex asks for all.
        tail = TAILS.get(kind, body + b"{" + count + b",}")
        rules.append(Rule(kind, rb"(?<![A-Za-z0-9_])" + prefix + tail, 1, TRIGGERS.get(kind, prefix + (body if least else b"")), True))
    return rules


def build(rules: list[Rule]) -> Automaton:
    return compile_rules([(r.trigger, r.bounded) for r in rules])


class Finder:
    """Linked states and compiled regexes of a task."""

    def __init__(self, rules: list[Rule], automaton: Automaton):
        self.rules, self.automaton = rules, automaton
        self.start = automaton.rows()[0]
        self.exact = [re.compile(r.pattern) for r in rules]

    def __call__(self, text: bytes) -> list[tuple[int, int, int]]:
        """(byte start, rule, byte end) of every span, in text order."""
        spans = []
        for k in scan(text, self.automaton, self.start):
            rule, group = self.rules[k], "v" if "v" in self.exact[k].groupindex else 0
            spans += [(m.start(), k, m.end()) for m in self.exact[k].finditer(text) if len(m[group]) >= rule.least]
        return sorted(spans)


def _kernel(rules: list[Rule], automaton: Automaton, describe):
    finder = None

    def run(batch: pa.RecordBatch) -> dict:
        nonlocal finder
        finder = finder or Finder(rules, automaton)
        return describe([(text, finder(text) if text else []) for text in batch.column(TEXT).to_pylist()], rules)

    return run


def _spans(found, rules: list[Rule]) -> dict:
    out = []
    for text, spans in found:
        points = code_points(np.frombuffer(text, np.uint8)) if spans else []
        out.append([{"kind": rules[k].kind, "start": int(points[a]), "end": int(points[b])} for a, k, b in spans])
    return {"spans": out}


def find_secrets(df: DataFrame, keep: list[str], text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """One row per row of `df`: `keep` and all spans (kind, start, end in code points, end exclusive).

    Spans are ordered by start, then rule order. Null and empty texts have none; rows that repeat
    give repeated results.
    """
    rules = rules or secret_rules()
    return scan_text(df, keep, text, _kernel(rules, build(rules), _spans), "spans array<struct<kind:string,start:bigint,end:bigint>>")


def _redacted(found, rules: list[Rule]) -> dict:
    out = []
    for text, spans in found:
        if not spans:
            out.append(None)
            continue
        pieces, at = [], 0
        for start, k, end in spans:
            if start >= at:
                pieces += [text[at:start], b"[" + rules[k].kind.encode() + b"]"]
            at = max(at, end)
        out.append(b"".join([*pieces, text[at:]]).decode("utf-8", "replace"))
    return {"_redacted": out}


def redact_secrets(df: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """`df` with every span in `text` replaced by its kind in brackets; overlapping spans become one."""
    rules = rules or secret_rules()
    found = scan_text(df, df.columns, text, _kernel(rules, build(rules), _redacted), "_redacted string")
    return found.withColumn(text, F.coalesce("_redacted", text)).select(*df.columns)
