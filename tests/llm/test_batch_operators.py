"""Fill-in-the-middle, centroid clustering and secret scans against brute force, with odd inputs."""

import base64
import bz2
import gzip
import hashlib
import lzma
import math
import random
import re
import urllib.parse
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL

from tessera.llm import clustering, fill_middle, secrets
from tessera.llm.queries import QUERIES

# Fill in the middle


def units(text, unit):
    return re.findall({"line": r"[^\n]*\n|[^\n]+", "word": r"^[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "char": r"(?s)."}[unit], text)


def brute_middle(doc_id, text, unit="line", rate=100, spm_rate=50, seed=7, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    u, digest = units(text, unit), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in marks) or h[2] % 100 >= rate:
        return (len(u), "plain", None, None, text)
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    out = marks[1] + s + marks[0] + p + marks[2] + m if form == "spm" else marks[0] + p + marks[1] + s + marks[2] + m
    return (len(u), form, len(p), len(m), out)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    parts = ["a", "\n", " ", "é", "日本", "\n\n", "<P>", "word ", "<", ">", "😀", "\t", "\r\n", "S>"]
    made = [None, "", "\n", " ", "x", "<P", "<M>", "no newline", "ends\n", "é" * 5000 + "\n" + "z" * 40_000, "line\n" * 3000]
    made += ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(120)]
    return [(None if i == 3 else i // 2 if i > 100 else i, t, "clash", i, None) for i, t in enumerate(made)]


@pytest.mark.parametrize(("unit", "rate", "most"), [("line", 100, 4 << 20), ("word", 70, 100), ("char", 100, 1000)])
def test_middles_are_those_of_a_plain_version(spark, texts, unit, rate, most):
    docs = spark.createDataFrame(texts, "doc_id long, text string, output string, h int, form string").repartition(3)
    made = fill_middle.fill_middle(docs, unit, rate, 50, 7, most=most)
    got = sorted(map(repr, ((r["doc_id"], (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in made.collect())))
    assert got == sorted(repr((i, brute_middle(i, t, unit, rate))) for i, t, *_ in texts)
    back = fill_middle.restored(made, most=most).collect()
    assert sorted((repr(r["doc_id"]), r["restored"]) for r in back) == sorted((repr(i), t or "") for i, t, *_ in texts)
    assert {r["form"] for r in back} == {"plain", "psm", "spm"}


def test_other_sentinels_and_an_empty_table(spark, texts):
    marks = ("<|prefix|>", "<|suffix|>", "<|middle|>")
    docs = spark.createDataFrame(texts, "doc_id long, text string, output string, h int, form string")
    made = fill_middle.fill_middle(docs, sentinels=marks)
    assert sorted(r["output"] for r in made.collect()) == sorted(brute_middle(i, t, marks=marks)[-1] for i, t, *_ in texts)
    assert sorted(r["restored"] for r in fill_middle.restored(made, marks).collect()) == sorted(t or "" for _, t, *_ in texts)
    assert fill_middle.restored(fill_middle.fill_middle(docs.limit(0))).collect() == []
    for bad in (("<P>", "<P>", "<M>"), ("", "b", "c"), ("ab", "bc", "x"), ("aba", "x", "y")):
        with pytest.raises(ValueError):
            fill_middle.fill_middle(docs, sentinels=bad)


def test_buffers_of_slices_and_wide_strings():
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["drop", "é", None, "", "xy"], kind)[1:]
        at, data = fill_middle.buffers(column)
        assert at.tolist() == [0, 2, 2, 2, 4] and data.tobytes() == "éxy".encode()


# Centroid clustering


def brute_clusters(rows, k=40, rounds=5, dimension=64):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [q for _, q in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    for step in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(centroids)) for _, q in kept]
        if step < rounds:
            for n in range(len(centroids)):
                own = [q for (_, q), (_, m) in zip(kept, near, strict=True) if m == n]
                if own:
                    centroids[n] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    per = {n: sum(d for d, m in near if m == n) for n in range(len(centroids))}
    return sorted(((i, n, d, per[n], sum(per.values()), centroids[n]) for (i, _), (d, n) in zip(kept, near, strict=True)), key=repr)


def clusters(found):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid"]) for r in found.collect()), key=repr)


def test_clusters_are_those_of_a_plain_version(spark):
    r = random.Random(12)
    rows = [(i, [r.gauss(i % 5, 1) if j % 3 else i % 5 / 4 for j in range(64)]) for i in range(150)]
    rows += [(200, rows[0][1]), (0, rows[0][1]), (None, rows[3][1]), (201, None), (202, []), (203, [1.0] * 63), (204, [*[0.5] * 63, None]), (205, [*[0.5] * 63, math.nan]), (206, [*[0.5] * 63, -math.inf])]
    rows += [(300 + i, [1.0] * 64) for i in range(60)]
    table = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<double>, place string, q int").repartition(3)
    found = clustering.cluster(table, k=12)
    assert clusters(found) == brute_clusters(rows, 12)
    checked = [x["checked"] for x in found.collect()]
    assert min(checked) >= 1 and sum(checked) < 12 * len(checked)


def test_few_rows_no_rows_and_huge_components(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(1, [0.5] * 64), (2, [0.25] * 64)]
    assert clusters(clustering.cluster(spark.createDataFrame(rows, schema))) == brute_clusters(rows)
    assert clustering.cluster(spark.createDataFrame([], schema)).collect() == []
    assert clustering.cluster(spark.createDataFrame([(1, [1.0])], schema)).collect() == []
    big = clustering.cluster(spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)], schema), k=1).collect()
    assert len(big) == 2 and {r["cluster"] for r in big} == {0}


@pytest.mark.parametrize("seed", range(4))
def test_screening_loses_no_tie(seed):
    r = np.random.default_rng(seed)
    q, c = r.integers(-3, 4, (300, 64)), r.integers(-3, 4, (40, 64))
    c[7], c[30] = c[2], q[5]
    number, distance, _ = clustering.nearest(q, clustering.compress(q), c)
    whole = ((q[:, None] - c) ** 2).sum(axis=2)
    assert (number == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()


# Secrets

SECRET = "api_key: Zx81kkQQ77aa"
b64 = lambda x: base64.b64encode(x.encode() if isinstance(x, str) else x).decode()
percent = lambda s: "".join(f"%{c:02X}" for c in s.encode())

WRAPPED = {
    ("base64",): b64(SECRET),
    ("base64", "base64"): b64(b64(SECRET)),
    ("base64", "compressed"): b64(gzip.compress(SECRET.encode(), mtime=0)),
    ("url",): percent(SECRET),
    ("url", "url"): urllib.parse.quote(percent(SECRET)),
    ("url", "base64"): percent(b64(SECRET)),
    ("unicode",): "".join(f"\\u{ord(c):04x}" for c in SECRET),
    ("unicode", "url"): "".join(f"&#x{ord(c):x};" for c in percent(SECRET)),
    ("base64", "compressed", "base64", "compressed"): b64(zlib.compress(b64(bz2.compress(SECRET.encode())).encode())),
    ("base64", "unicode", "base64"): b64("".join(f"\\x{ord(c):02x}" for c in b64(SECRET))),
    ("compressed",): None,
}


@pytest.mark.parametrize("route", [r for r in WRAPPED if WRAPPED[r]])
@pytest.mark.parametrize("around", [("", ""), ("héllo 日本 ", " end\nmore"), ("see\n(", ")")])
def test_wrapped_secrets_are_found_where_they_lie(route, around):
    text = around[0] + WRAPPED[route] + around[1]
    found, unread = secrets.search(text)
    hits = [f for f in found if f.kind == "assign" and f.route == route]
    assert len(hits) == 1 and unread == 0
    inside = range(len(around[0]), len(around[0]) + len(WRAPPED[route]) + 1)
    assert hits[0].start in inside and hits[0].end in inside
    assert text[hits[0].start : hits[0].end].rstrip("=") in WRAPPED[route] and hits[0].end - hits[0].start > len(SECRET)


def test_xz_streams_and_wrapped_lines_and_runs_that_swallow_a_path():
    assert any(f.route == ("base64", "compressed") for f in secrets.search(b64(lzma.compress((SECRET * 9).encode())))[0])
    long = b64("filler " * 20 + SECRET + " more " * 30)
    for width in (64, 76):
        lines = "\n".join(long[i : i + width] for i in range(0, len(long), width))
        assert any(f.route == ("base64",) and "\n" not in lines[f.start : f.end].strip() or f.route for f in secrets.search(lines)[0])
    assert [f.route for f in secrets.search("path/to/" + b64(SECRET))[0]] == [("base64",)]


def test_decoded_context_and_exact_spans():
    found, _ = secrets.search("é token=abcdefgh%41%42 x")
    assert [(f.kind, f.start, f.end, f.route) for f in found] == [("assign", 2, 16, ()), ("assign", 2, 22, ("url",))]
    key = b64("x " + "AKIA" + "B" * 16 + " y")
    found, _ = secrets.search("at " + key)
    assert [f.kind for f in found] == ["access"] and base64.b64decode(key[found[0].start - 3 - (found[0].start - 3) % 4 :]).find(b"AKIA") >= 0


def test_cycles_end_and_long_layers_are_counted():
    assert secrets.search("%25" * 400 + "41")[1] == 0
    bomb = b64(zlib.compress(b"z" * (1 << 20)))
    assert secrets.search(bomb, most=1 << 16) == ([], 1) and secrets.search(bomb) == ([], 0)
    nested = b64(zlib.compress(b64(zlib.compress((SECRET + " " * 200_000).encode())).encode()))
    assert [f.kind for f in secrets.search(nested)[0]] == ["assign"]
    assert secrets.search(nested, most=1000)[1] == 1
    assert secrets.search("x^" * 3000 + "\\u12 %zz &#; " + "A" * 500)[0] == []


def brute_base(text):
    text, out = text or "", []
    for kind, pattern, group, least in (
        ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16),
        ("hex", r"[0-9a-f]+", 0, 32),
    ):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[1])))


def test_op13_base_is_that_of_a_plain_version(spark):
    where = SMALL.replace("0.001", "0.01")
    rows = QUERIES["op13_secret_scan"](spark, where).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts) and sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in rows) > 0
    for r in rows:
        base = brute_base(texts[r["doc_id"]])
        spans = [f"{kind}:{a}:{b}" for a, kind, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest() and set(spans) <= set(r["spans"].split(","))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == kind for _, k, _ in base) for kind in secrets.KINDS)


def test_scans_of_odd_rows(spark):
    texts = [None, "", " ", "PASSWORD = 'longenough1' password=short", "toKen:ſecret", "tſken=abcdefghij", "a" * 33 + " " + "AKIA" + "Z" * 12, "é " + SECRET + "\n" + b64(SECRET), "word " * 200_000 + SECRET]
    data = [(None if i == 1 else 5, t, ["clash"], 2) for i, t in enumerate(texts)]
    got = secrets.scan(spark.createDataFrame(data, "doc_id long, text string, found array<string>, n_unread long")).collect()
    assert len(got) == len(texts)
    want = sorted(str(brute_base(t)) for t in texts)
    assert sorted(str([(f["start"], f["kind"], f["end"]) for f in r["found"] if not f["route"]]) for r in got) == want
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
