"""Personal data: base spans against plain regular expressions, disclosing terms against counts, plan without Python."""

import hashlib
import math
import random
import re

import pandas as pd
import pytest

from shardwell.llm import queries, sanitise
from tests.llm.test_free import ODD
from tests.oracle import bag

SCHEMA = "doc_id long, text string, row long, entity string, spans string, email string"


def luhn(number):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(number))) % 10 == 0


# The contract's patterns.
BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
]
HARD = [
    "a@b.c_x@d.e.f a.b@c@d.e x@y. x@y @z.z a%b+c@d-e.f-g.h",
    "a@b.c@d.e@f.g-h@i.j. é@x.yz é1.2.3.4é",
    "1.2.3.4.5.6.7.8 256.1.1.1 0255.0.00.001 01.02.03.0999 1..2.3.4 1.2.3.",
    "4111 1111 1111 1111, 4111-1111-1111-1111; 4111  1111 4111 1111 1111 1112 7 4111111111111111 x4111111111111111x",
    "+1 (523) 555-1055 +12 +1234567 +1 2345678901234567 ++1-800-555-0000.. +1+2 345 678 90",
    "12 34-56 78 90 12-34 5670 00000000000000000 0000000000000000000 00000000000000000000",
    "p\N{GRINNING FACE}q mail x.y@z.w \N{GRINNING FACE} +49 30 1234567\ttab 10.0.0.1\N{GRINNING FACE}",
    "1 " * 3000 + "4111111111111111 " + "9.9.9.9 a@b.cd " * 700,
    "7" * 20_000 + "." + "a" * 20_000 + "@",
]


def base(text):
    return [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, text) if ok(m.group())]


def associated(seed=3):
    """Texts in which a name stands by an address, beside texts without, and the same names elsewhere."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randrange(2, 6)))
    rows = []
    for k in range(150):
        around = [word() for _ in range(r.randrange(3, 30))]
        put = {0: "Zora (Quill) zora.q@mail.example.com xylem", 1: "call Bruno at +49 30 1234567, Bruno", 2: "host 10.1.2.3 kilo", 3: "Zenith kilo brunel"}.get(k % 6)
        if put:
            around.insert(r.randrange(len(around)), put)
        rows.append((k, " ".join(around)))
    return rows + [(1000 + k, rows[k][1]) for k in range(40)]


def disclosing(rows):
    """(entity, term) -> action, by counting distinct texts."""
    texts = {t or "" for _, t in rows}
    trim = lambda w: re.sub("[A-Z]", lambda m: m.group().lower(), w.strip(sanitise.PUNCTUATION))
    near, own = {}, {}
    for t in texts:
        for kind, p, ok in BASE:
            spans = [m.span() for m in re.finditer(p, t)]
            for i, (s, e) in enumerate(spans):
                if not ok(t[s:e]):
                    continue
                value = t[s:e].lower() if kind == "email" else t[s:e] if kind == "ip" else re.sub("[^0-9]", "", t[s:e])
                entity = f"{kind}:{value}"
                own.setdefault(entity, set()).add(t)
                left, right = t[spans[i - 1][1] if i else 0 : s], t[e : spans[i + 1][0] if i + 1 < len(spans) else len(t)]
                before = [w for w in re.finditer(r"[^\x20\x09-\x0D]+", left) if w.start() > len(left) - 200 or len(left) <= 200][-8:]
                after = [w for w in re.finditer(r"[^\x20\x09-\x0D]+", right) if w.end() < 200 or len(right) <= 200][:8]
                for w in before + after:
                    term = trim(w.group())
                    if term and not re.search("[0-9@+]", term):
                        near.setdefault((entity, term), set()).add(t)
    words = {t: {trim(w) for w in re.split(r"[\x20\x09-\x0D]", t)} - {""} for t in texts}
    n, out = len(texts), {}
    for (entity, term), both in near.items():
        if len(both) < 3 or len(own[entity]) == n:
            continue
        share = lambda b, f: math.log(n * b / (f * len(own[entity]))) / math.log(n / len(own[entity]))
        if share(len(both), sum(term in w for w in words.values())) >= 0.95:
            wide = {t for (x, y), ts in near.items() if x == entity and y[:4] == term[:4] for t in ts}
            f = sum(any(x[:4] == term[:4] for x in w) for w in words.values())
            out[entity, term] = "remove" if share(len(wide), f) >= 0.95 else "generalise"
    return out


@pytest.fixture(scope="module")
def rows():
    return associated() + [(2000 + k, t) for k, t in enumerate(HARD)] + [x for x in ODD if x[0] != 906]


@pytest.fixture(scope="module")
def done(spark, rows):
    data = spark.createDataFrame([(*x, 5, "clash", "clash", "clash") for x in rows], SCHEMA).repartition(5)
    return sanitise.Sanitiser(data, texts=True)


def test_base_spans(rows, done):
    want = sorted((str(i), ",".join(f"{k}:{a}:{b}" for k, a, b in base(t or ""))) for i, t in rows)
    out = sanitise.digests(done.spans()).collect()
    only = lambda s: ",".join(x for x in s.split(",") if not x.startswith("term"))
    assert sorted((str(x.doc_id), only(x.spans)) for x in out) == want
    assert sorted(x.base_sha256 for x in out) == sorted(hashlib.sha256(w.encode()).hexdigest() for _, w in want)
    by = {x.doc_id: x for x in out}
    assert by[2002].n_ip == sum(k == "ip" for k, *_ in base(HARD[2])) and by[2003].n_card == sum(k == "card" for k, *_ in base(HARD[3]))


def test_terms(rows, done):
    want = disclosing(rows)
    assert {(x.entity, x.term): x.action for x in done.disclosed.collect()} == want
    assert {("email:zora.q@mail.example.com", "quill"), ("phone:49301234567", "bruno")} <= want.keys() and {"remove", "generalise"} == set(want.values())
    assert not any(t == "kilo" for _, t in want)  # as often elsewhere
    texts = dict(rows)
    for x in done.spans().collect():
        for t in x.terms:
            term = texts[x.doc_id][t.start : t.end].lower()
            assert any(want.get((e, term)) for e in {k[0] for k in want})
        if not x.spans:
            assert not x.terms  # a text without entities is left alone
    by = {x.doc_id: x.text for x in done.sanitised().collect()}
    assert "[EMAIL]" in by[0] and "zora.q" not in by[0] and "Quill" not in by[0] and "[PHONE]" in by[1] and "Bruno" not in by[1]
    assert by[2003].startswith("[CARD]") and "4111 1111 1111 1111" not in by[2003]


def test_shuffled_terms(spark, rows, monkeypatch):
    monkeypatch.setattr(sanitise, "BROADCAST_TERMS", 0)
    data = spark.createDataFrame([x for x in rows if x[0] != 2007], "doc_id long, text string").repartition(3)
    got = {(x.entity, x.term): x.action for x in sanitise.Sanitiser(data).disclosed.collect()}
    assert got == disclosing([x for x in rows if x[0] != 2007])


def test_sql_on_associated_texts(spark, tmp_path, rows):
    pd.DataFrame({"doc_id": [x[0] for x in associated()], "text": [x[1] for x in associated()]}).to_parquet(tmp_path / "documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    ours = bag(queries.op11_pii(spark, str(tmp_path)).toPandas())
    assert ours == bag(con.execute(queries.ORACLE["op11_pii"]).df()) and any("term:" in str(r) for r in ours[1])


def test_native_and_empty(spark):
    plan = queries.op11_pii(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert sanitise.digests(sanitise.Sanitiser(spark.createDataFrame([], "doc_id long, text string")).spans()).count() == 0
