import hashlib
import re

from hawkspan.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def expected(text):
    spans = []
    for order, (kind, pattern) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                spans.append((m.start(), order, m.end(), kind))
    return sorted(spans)


CASES = [
    None, "", "plain words", "a@b.c@d.e", "a@b.cd%x@y.z", "x@y", "é ü 💡 mail: ann.lee+x@mail.example.org, bob@x.de", "1.2.3.4.5.6.7.8", "999.1.1.1 10.0.0.255 0000.00.0255.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111  1111", "+49 (30) 123-456 78 +1", "+1234567890123456", "iban DE89 3704 0044 0532 0130 00 x", "account GB82WEST12345698765432",
    "DE89370400440532013000", "ssn 123-45-6789", "123-45-6789", "1 " * 30000, "9" * 30000, "a" * 50000, "a." * 30000 + "@", "x@" + "a." * 30000 + "b", "iban DE89370400440532013001", "a@b.c " * 3000, "+1((((" * 2000, "1.2.3.4 5.6.7.8\n\r4111111111111111\n",
]


def found(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, content string")
    return {r.doc_id: r for r in pii.find_pii(docs).collect()}


def test_base_spans_equal_brute_force(spark):
    got = found(spark, CASES)
    assert len(got) == len(CASES)
    for i, text in enumerate(CASES):
        base = [(s.start, s.order, s.end, s.kind) for s in got[i].pii if s.order < 4]
        assert base == expected(text or ""), (i, (text or "")[:60])
    assert got[0].content == "x"


def test_added_spans_need_checksum_or_context(spark):
    got = found(spark, CASES)
    kinds = {i: [s.kind for s in got[i].pii if s.order >= 4] for i in got}
    assert kinds[12] == kinds[13] == kinds[14] == ["iban"]
    assert kinds[15] == ["ssn"] and kinds[16] == [] and kinds[CASES.index("iban DE89370400440532013001")] == []
    scores = [next(s.score for s in got[i].pii if s.kind == "iban") for i in (12, 14)]
    assert scores == [1.0, 0.7]


def test_all_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = pii.op2(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = expected(texts[r.doc_id] or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w[3] == k for w in want) for k in ("email", "ip", "card", "phone"))


def test_empty_table_and_plan_without_python(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, pii string")
    assert pii.find_pii(docs.drop("pii")).count() == 0
    plan = pii.op2(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("regexp_extract_all(") == len(pii.KINDS)
