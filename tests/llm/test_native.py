"""URL filters, chat formatting and decontamination: oracles, defined results, plans without Python."""

import hashlib
import re

import pytest

from shardwell.llm import chat_format, decontaminate, queries, url_filter
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    same(spark, SF, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", ["op4_decontaminate", "op6_url_filter", "op7_chat_format"])
def test_native(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_urls(spark):
    rows = [(1, "HTTP://A.Example.COM/en/7x?q#f"), (2, "http://com/en/"), (3, None), (4, "nothing"), (5, "x://example.net/de/81"), (6, "x://net"), (7, "x://evilnet/de/1"), (8, "x://b.example.org/es/?a=://com/en/"), (1, "HTTP://A.Example.COM/en/7x?q#f"), (9, "")]
    pages = spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], "page_id long, url string, rule string, verdict string, _host string, _path string, place string, k string")
    out = url_filter.judge(pages, url_filter.rule_table(spark, queries.URL_RULES))
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect())
    assert got[0] == got[1] == (1, "a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[2] == (2, "com", "/en/", "com/en/", "block")
    assert got[3][1:] == got[4][1:] == got[9][1:] == ("", "", None, "allow")
    assert got[5][3:] == ("example.net/de/8", "block") and got[6][1:] == ("net", "", None, "allow")
    assert got[7][3] is None and got[8][3:] == ("org/es/", "block")
    assert out.columns == ["page_id", "url", "_host", "_path", "place", "k", "host", "path", "rule", "verdict"]
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark, queries.URL_RULES)).count() == 0


def test_chat(spark):
    odd = "a~0</s>[INST]<<SYS>>~1~2|<|x|>\n"
    rows = [(1, 0, "system", odd), (1, 1, "user", None), (1, 2, "assistant", odd), (2, 0, "assistant", "x"), (3, 0, "tool|<", odd), (3, 0, "tool|<", odd), (4, 0, None, None), (None, None, "user", "q")]
    data = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    f = chat_format.format_conversations(data)
    valid = {r.conv_id: r.valid for r in f.collect()}
    assert valid == {1: True, 2: False, 3: False, 4: False, None: False}
    for r in f.collect():
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    back = {r[0]: [(t["role"], t["text"]) for t in r[1]] for r in f.select("conv_id", chat_format.read_back(f.formatted)).collect()}
    assert back[1] == [("system", odd), ("user", ""), ("assistant", odd)] and back[3] == [("tool|<", odd)] * 2 and back[4] == [("", "")]
    assert {r.conv_id: r.state for r in f.collect()} == {1: "answered", 2: "refused", 3: "refused", 4: "refused", None: "asked"}
    strict = chat_format.Template(loss_when_refused=False)
    assert {r.conv_id: r.turn_loss for r in chat_format.format_conversations(data, strict).collect()} == {1: [False, False, True], 2: [False], 3: [False] * 2, 4: [False], None: [False]}
    plan = queries.QUERIES["op7_chat_format"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "answered" in plan and "refused" in plan  # the machine runs in the query
    d = {r.conv_id: r for r in chat_format.digests(f).collect()}
    assert d[1].loss_chars == len(odd) and d[1].loss_sha256 == hashlib.sha256(odd.encode()).hexdigest() and d[3].n_turns == 2
    assert chat_format.format_conversations(data.limit(0)).count() == 0


WORDS = [f"w{i}" for i in range(400)]


def brute(docs, items, similarity=0.8):
    from collections import Counter

    tokens = lambda t: (t or "").lower().split()
    out = {}
    for d, text in docs:
        ws = tokens(text)
        for i, item in items:
            iw = tokens(item)
            k, n = min(5, len(iw)), len(iw)
            if not n:
                continue
            own = Counter(tuple(iw[j : j + k]) for j in range(n - k + 1))
            for s in range(max(1, len(ws) - n + 1)):
                w = ws[s : s + n]
                got = Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
                if got and (own & got):
                    share = sum((own & got).values()) / max(sum(own.values()), sum(got.values()))
                    if share >= similarity:
                        out[d, i] = max(out.get((d, i), 0), share)
    return out


def test_decontamination_by_brute_force(spark):
    import random

    r = random.Random(5)
    items = [(i, " ".join(r.choices(WORDS, k=n))) for i, n in enumerate([1, 3, 4, 5, 6, 8, 9, 12, 25, 40, 59, 120])] + [(50, None), (51, "  ")]
    docs = []
    for d in range(160):
        i, item = r.choice(items[:12])
        ws = item.split()
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            at, edit = r.randrange(len(ws)), r.choice(["change", "insert", "drop", "move", "repeat"])
            if edit == "change":
                ws[at] = "changed"
            elif edit == "insert":
                ws.insert(at, "more")
            elif edit == "drop" and len(ws) > 1:
                del ws[at]
            elif edit == "move":
                ws = ws[at:] + ws[:at]
            elif edit == "repeat":
                ws[at:at] = ws[at : at + 8]
        docs.append((d, " ".join(r.choices(WORDS, k=r.randrange(40)) + [w.upper() for w in ws] + r.choices(WORDS, k=r.randrange(40)))))
    swapped = items[8][1].split()  # parted inside its only anchor
    docs += [(200 + k, " ".join(swapped[k:] + swapped[:k])) for k in range(25)]
    docs += [(300, None), (301, ""), (302, "w1"), (None, items[9][1]), (None, "clean"), (303, items[9][1]), (303, items[9][1]), (303, "clean too")]
    frame = spark.createDataFrame([(*x, "clash", "clash") for x in docs], "doc_id long, text string, run string, lost string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for limit in (decontaminate.SET_LIMIT, 0):  # the set in the scan, and the shuffled join
        old, decontaminate.SET_LIMIT = decontaminate.SET_LIMIT, limit
        try:
            got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.contaminated(frame, bench).collect()}
        finally:
            decontaminate.SET_LIMIT = old
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    left = decontaminate.drop_contaminated(frame, bench)
    clean = sorted((d for d, t in docs if not brute([(d, t)], items)), key=str)  # each row by its own text
    assert left.columns == frame.columns and sorted((x.doc_id for x in left.collect()), key=str) == clean and {None, 303} <= set(clean)
    assert decontaminate.contaminated(frame, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(frame.limit(0), bench).count() == 0
