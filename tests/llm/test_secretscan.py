"""Secret scans against the patterns run over whole texts, and against texts with planted tokens."""

import hashlib
import random
import re
import zlib

import pandas as pd
import pytest

from ladle.llm import queries
from ladle.llm import secretscan as S

SF = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
CHARS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def signed(prefix, body):
    value, digits = zlib.crc32(body.encode()), ""
    while value or len(digits) < 6:
        digits = CHARS[value % 62] + digits
        value //= 62
    return prefix + body + digits


def expected(i, text):
    spans = base(text or "")
    names = [k for k, _, _ in spans]
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return (i, names.count("assign"), names.count("access"), names.count("hex"), hashlib.sha256(joined.encode()).hexdigest(), joined)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    parts = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "apikey", "AKIA", "akia", "ſecret", "toKen", ":", "=", " = ", "=='", "\"", "'", " ", "\n", "é", "漢", "abc", "abcdef", "A1B2C3D4E5F6G7H8", "deadbeef", "0123456789abcdef", ".", "-", "_", "/", "|", "ABCDEFGHIJKLMNOP0123"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(400)]
    fixed = [None, "", "hex at the end " + "0" * 23, "0" * 24, "f" * 100_000, "token=" * 3000 + "abcdef", "token:short token: longer_one", "AKIA" * 6, "password: 'hunter22'; api_key=x"]
    # A run of digits goes on in the next row's text, but texts share no run.
    return list(enumerate([*texts, *fixed, "x" + "a" * 12, "b" * 12, "c" * 30, "d" * 30]))


def test_against_whole_patterns(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = {r["doc_id"]: r["secrets"] for r in S.with_secrets(df).collect()}
    for i, text in rows:
        assert [tuple(s) for s in got[i]] == base(text or ""), (i, text)


def test_op12(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    want = {expected(i, t) for i, t in zip(docs["doc_id"].tolist(), docs["text"])}
    got = queries.queries()["op12_secrets"](spark, SF)
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert set(map(tuple, got.collect())) == want and any(r[1] for r in want)


def test_checksums(spark):
    rng = random.Random(2)
    bodies = ["".join(rng.choice(CHARS) for _ in range(30)) for _ in range(40)]
    good = [signed(p, b) for b in bodies for p in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")]
    bad = [g[:10] + ("a" if g[10] != "a" else "b") + g[11:] for g in good] + [g + "x" for g in good] + [g[:-1] for g in good]
    df = spark.createDataFrame([(i, f"é {g}, then") for i, g in enumerate(good + bad)], "doc_id long, text string")
    got = {r["doc_id"]: [s for s in r["secrets"] if s["kind"] in ("github", "npm")] for r in S.with_secrets(df).collect()}
    for i, g in enumerate(good):
        assert [tuple(s) for s in got[i]] == [("npm" if g[0] == "n" else "github", 2, 42)]
    assert not any(got[i] for i in range(len(good), len(good + bad)))


def test_order_of_equal_starts_and_added_spans(spark):
    token = signed("ghp_", "0123456789abcdef0123456789abcZ")
    text = f"token={token}"
    spans = S.with_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["secrets"]
    assert [tuple(s) for s in spans] == [("assign", 0, 46), ("github", 6, 46), ("hex", 10, 39)]


def test_redacted_and_odd_columns(spark):
    data = [(1, "é token = abcdef12 end", "s", "x"), (None, None, "s", None), (1, "é token = abcdef12 end", "s", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, secrets string, `a b``c` string")
    out = S.redacted(df)
    assert out.columns == df.columns and [r["text"] for r in out.collect()] == ["é ****************" + " end", None, "é ****************" + " end"]
    assert S.with_secrets(df).columns == ["doc_id", "text", "a b`c", "secrets"]
    assert S.with_secrets(df.where("false")).collect() == []
