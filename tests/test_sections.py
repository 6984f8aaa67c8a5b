"""Sections and ranges within one budget against plain loops."""

import random

from tessera.operators import sections


def plain_fit(items, budget):
    """Drop from the section that can give most until the rest fits, as a loop."""
    held = {}
    for s, place, chars in sorted(items):
        held.setdefault(s, []).append(chars + sections.BETWEEN)
    excess = sum(map(sum, held.values())) - budget
    status = "ready" if excess <= 0 else "clipped"
    excess = 0 if excess <= 0 else excess + sections.SLACK
    for layer in (0, 1):
        least = {s: sections.MINIMUMS.get(s, 1) if layer == 0 else 0 for s in held if layer == 0 or s in sections.LAST}
        for s in sorted(least, key=lambda s: (-sum(held[s][least[s] :]), s)):
            removed = 0
            while len(held[s]) > least[s] and removed < excess:
                removed += held[s].pop()
            excess = max(0, excess - removed)
    return {s: len(v) for s, v in held.items()}, "exceeded" if sum(map(sum, held.values())) > budget else status


def test_sections_give_in_the_order_of_what_they_can(spark):
    r = random.Random(13)
    names = ["symbols", "edges", "paths", "unresolved", "diagnostics", "ownership", "other"]
    rows = [(q, s, k, r.randrange(5, 300)) for q in range(60) for s in r.sample(names, r.randint(1, 6)) for k in range(1, r.randint(2, 12))]
    fitted = sections.fit_sections(spark.createDataFrame(rows, "request long, section string, place int, chars int").repartition(4), 1500)
    got = fitted.collect()
    lost = {(x["request"], x["section"]): (x["original"], x["returned"]) for x in sections.clipped_fields(fitted).collect()}
    seen = set()
    for q in range(60):
        own = [(s, k, c) for p, s, k, c in rows if p == q]
        want, status = plain_fit(own, 1500)
        mine = [x for x in got if x["request"] == q]
        assert {s: sum(x["kept"] for x in mine if x["section"] == s) for s in want} == want and {x["status"] for x in mine} == {status}
        assert all(x["place"] <= want[x["section"]] for x in mine if x["kept"])
        assert {s: v for (p, s), v in lost.items() if p == q} == {s: (sum(o[0] == s for o in own), n) for s, n in want.items() if n < sum(o[0] == s for o in own)}
        seen.add(status)
    assert seen == {"ready", "clipped"} or seen == {"ready", "clipped", "exceeded"}


def test_pages_of_many_ranges_cover_everything_once(spark):
    r = random.Random(14)
    texts = {f"f{k}": "".join("x" * r.randrange(0, 30) + "\n" for _ in range(r.randrange(1, 12))) for k in range(6)}
    files = spark.createDataFrame(list(texts.items()), "path string, content string")
    ranges = [(q, i, f"f{r.randrange(6)}", a := r.randrange(1, 8), a + r.randrange(0, 6), r.randrange(0, 4)) for q in range(8) for i in range(r.randint(1, 4))]
    now = spark.createDataFrame(ranges, "request long, item int, path string, start_line int, end_line int, char_offset int")
    want, got = {}, {}
    for q, i, p, a, b, c in ranges:
        lines = texts[p].split("\n")[:-1]
        for n in range(a, min(b, len(lines)) + 1):
            want[q, i, n] = lines[n - 1][c if n == a else 0 :]
    for _ in range(12):
        for x in sections.read_ranges(files, now, 60).collect():
            got[x["request"], x["item"], x["line"]] = got.get((x["request"], x["item"], x["line"]), "") + x["text"]
        cursors = sections.range_cursors(files, now, 60).collect()
        if not cursors:
            break
        now = spark.createDataFrame(sections.resumed(now, spark.createDataFrame(cursors)).collect(), now.schema)
    assert got == want and not cursors


def test_sections_are_fitted_with_one_exchange(spark):
    items = spark.range(500).selectExpr("id div 50 as request", "concat('s', id % 4) as section", "id div 4 as place", "id as chars")
    plan = sections.fit_sections(items, 300)._jdf.queryExecution().sparkPlan().toString()
    run = sections.fit_sections(items, 300)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and run.count("Exchange hashpartitioning") == 1
