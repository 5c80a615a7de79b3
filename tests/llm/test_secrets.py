import time

import pytest

from brightshelf.llm import secrets

RULES = secrets.secret_rules()
FINDER = secrets.Finder(RULES, secrets.build(RULES))
B64 = "MIIEpAIBAAKCAQEA" * 4


def spans(text, kind):
    return [text.encode()[a:b].decode() for a, k, b in FINDER(text.encode()) if RULES[k].kind == kind]


BODIES = {
    "github": "ghp_" + "a" * 36,
    "github-fine": "github_pat_" + "a" * 40,
    "gitlab": "glpat-" + "a" * 20,
    "slack": "xoxb-" + "a" * 24,
    "slack-app": "xapp-1-" + "a" * 24,
    "slack-hook": "hooks.slack.com/services/" + "T0/B0/" + "a" * 24,
    "google-api": "AIza" + "a" * 35,
    "google-oauth": "ya29." + "a" * 40,
    "stripe": "sk_live_" + "a" * 24,
    "stripe-hook": "whsec_" + "a" * 32,
    "sendgrid": "SG." + "a" * 22 + "." + "a" * 43,
    "npm": "npm_" + "a" * 36,
    "pypi": "pypi-" + "a" * 60,
    "telegram": "1234567890:AA" + "a" * 33,
    "square": "sq0atp-" + "a" * 22,
    "shopify": "shpat_" + "a" * 32,
    "digitalocean": "dop_v1_" + "a" * 64,
    "dockerhub": "dckr_pat_" + "a" * 27,
    "databricks": "dapi" + "a" * 32,
    "huggingface": "hf_" + "a" * 34,
    "openai": "sk-proj-" + "a" * 48,
    "linear": "lin_api_" + "a" * 40,
    "postman": "PMAK-" + "a" * 24 + "-" + "a" * 34,
    "twilio": "SK" + "a" * 32,
    "mailgun": "key-" + "a" * 32,
    "aws-temporary": "ASIA" + "A" * 16,
    "jwt": "eyJ" + "a" * 33 + ".eyJ" + "a" * 40 + "." + "a" * 43,
    "bearer": "Authorization: Bearer " + "a" * 40,
    "basic-auth-url": "postgres://user:" + "p" * 33 + "@db.example.com",
}


@pytest.mark.parametrize("kind", sorted(BODIES))
def test_formats_with_long_values(kind):
    value = BODIES[kind]
    for whole in (value, value + value[-1] * 300):
        assert spans(f"see '{whole}' there", kind) == [whole]
    assert set(BODIES) | {"private-key"} == {k for k, *_ in secrets.FORMATS}


@pytest.mark.parametrize("header", [8, 40, 41, 59, 99, 1000])
def test_jwt_header_of_any_length(header):
    token = "eyJ" + "a" * header + ".eyJ" + "b" * 60 + "." + "c" * 43
    assert spans(f"jwt {token}\n", "jwt") == [token]


@pytest.mark.parametrize(
    "url",
    [
        "postgresql://app:" + "x" * 33 + "@db.internal",
        "mysql://" + "u" * 60 + ":s3cret@db.internal",
        "mongodb+srv://app:hunter2hunter2@cluster0.example.net",
        "postgresql+psycopg2://app:p%40ss%2Fword@db.internal",
        "https://me%40corp.com:p&ss;w=rd,(x)'y'@host.example",
        "rediss://default:" + "k" * 64 + "@cache.internal",
    ],
)
def test_login_urls(url):
    assert spans(f"url {url}/x", "basic-auth-url") == [url]


@pytest.mark.parametrize("name", ["PRIVATE KEY", "RSA PRIVATE KEY", "OPENSSH PRIVATE KEY", "PGP PRIVATE KEY BLOCK"])
@pytest.mark.parametrize("body", [f"\n{B64}\n{B64}\nab==\n", f"\\n{B64}\\nab==\\n", f"\r\nProc-Type: 4,ENCRYPTED\r\nVersion: GnuPG v2.0.22 (GNU/Linux)\r\n\r\n{B64}\r\n", f" {B64} {B64} "])
def test_private_key_ends_at_its_end_line(name, body):
    key = f"-----BEGIN {name}-----{body}-----END {name}-----"
    text = f"before {key}\nplain prose, which stays: it has commas\n{key} and more prose"
    assert spans(text, "private-key") == [key, key]


def test_private_key_cut_off():
    key = f"-----BEGIN PRIVATE KEY-----\n{B64}\n{B64}"
    assert spans(f"{key}\nHere follows prose of several words", "private-key") == [key]
    assert spans(key, "private-key") == [key]
    two = f"{key}\n-----BEGIN RSA PRIVATE KEY-----\n{B64}\n-----END RSA PRIVATE KEY-----"
    assert [s.rstrip("\n") for s in spans(two, "private-key")] == two.split("\n-----BEGIN RSA")[:1] + ["-----BEGIN RSA" + two.split("\n-----BEGIN RSA")[1]]


def test_open_repeats_stay_fast():
    began = time.perf_counter()
    for text in ("https://a:" * 50_000, "-----BEGIN PRIVATE KEY-----\n" * 20_000, "-----BEGIN PRIVATE KEY-----" + "\nabc d" * 50_000, "eyJ" + "a" * 300_000 + ".eyJ"):
        FINDER(text.encode())
    assert time.perf_counter() - began < 20
