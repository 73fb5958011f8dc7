import brute
from cases import awkward, empty, rows
from scoreloom.llm import pii

TEXTS = [
    "write to a.b@c-d.example.com, or a@b, or x@y.z_d@e.f", "ip 1.2.3.4.5 and 300.1.1.1 and 010.020.030.255 10.0.0.1",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 then 12345", "call +1 (314) 555-6532 4663622617512349 now",
    "+49 30 1234567", "é@é.com ünï x@exämple.com +1-2", None, "", "9" * 400, "a" * 5000 + "@b.c", "1." * 600, "+" + "1 " * 900,
    "mail joe [at] example [dot] com please", "2001:0db8:0000:0000:0000:ff00:0042:8329 host",
    "mark  and  in 1.2.3.4 text a@b.cc", "+1 (988) 555-2485 +1 (988) 555-2486", "card4532015112830366card",
]


def docs():
    return [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[0])]


def spans(df, name):
    return rows(df, "doc_id", pii.spelled(name))


def spelled(found):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def test_base_spans(spark):
    found = pii.personal_data(awkward(spark, docs()))
    assert spans(found, "base") == sorted(((i, spelled(brute.personal(t))) for i, t in docs()), key=repr)


def test_spans_hold_the_base(spark):
    found = pii.personal_data(awkward(spark, docs())).collect()
    for row in found:
        assert set(map(tuple, row["base"])) <= set(map(tuple, row["spans"]))


def test_adds_what_the_base_misses(spark):
    plain = [(i, f"words before +1 (314) 555-{6000 + i} words after, mail a{i}@mail.example.com") for i in range(40)]
    joined = [(100 + i, f"words +1 (314) 555-{6000 + i} 4663622617512349 after") for i in range(5)]
    decoys = [(200 + i, f"numbers {10 ** 15 + 7 * i} and 999.{i}.1.1") for i in range(20)]
    found = {r["doc_id"]: r for r in pii.personal_data(awkward(spark, plain + joined + decoys)).collect()}
    for i, text in joined:
        kinds = {s["kind"]: text[s["start"]:s["end"]] for s in found[i]["spans"]}
        assert kinds.get("card") == "4663622617512349" and kinds.get("phone", "").startswith("+1 (314)")
    for i, text in decoys:
        assert [tuple(s) for s in found[i]["spans"]] == brute.personal(text)


def test_redaction(spark):
    df = awkward(spark, [(1, "mail a@b.cc or +1 (314) 555-6532 é 1.2.3.4"), (2, "nothing"), (3, None)]).withColumn("n_chars", pii.F.length("text").cast("long"))
    out = pii.redact(df)
    assert out.columns == df.columns
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert texts[1] == ("mail [EMAIL] or [PHONE] é [IP]", 30)
    assert texts[2] == ("nothing", 7) and texts[3] == (None, None)


def test_empty_table(spark):
    assert pii.personal_data(empty(spark)).collect() == []


def test_estimates_separate_the_classes():
    post = pii.reliabilities({("card", "+++00"): 90.0, ("card", "+-+00"): 200.0, ("card", "0-000"): 50.0})
    assert post["card", "+++00"] > 0.9 and post["card", "0-000"] < 0.1
    assert pii.reliabilities({}) == {}
