import hashlib
import random
import re

from tremorlake.llm import pii

RAW = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    s = [int(c) for c in reversed(d)]
    return sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d) % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]


def brute(text):
    spans = [(m.start(), k, kind, m.end()) for k, kind in enumerate(RAW) for m in re.finditer(RAW[kind], text or "", re.ASCII) if good(kind, m[0])]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans)]


PARTS = ["a@b.c", "x.y_z@h-1.co.uk", "@", ".", "..", " ", "-", "+", "+1 (555) 123-4567", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "256.1.1.1", "001.02.3.255", "1.2.3.4.5.6.7.8", "é", "😀", "_q@r.st", "0", "12", "card ", "\n", "DE89370400440532013000", "9" * 25, "(", ")", "+49.30.1234567890 12"]


def test_spans_against_brute_force(spark):
    r = random.Random(3)
    texts = [None, "", "a@b.c_d@e.f@g.h", "😀 a@b.cd", "9" * 50_000, "a" * 50_000, "a.@" * 3000, "1." * 5000, "+1" + "(" * 20_000, "a@b.c " * 300] + ["".join(r.choice(PARTS) for _ in range(r.randrange(1, 25))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for row in pii.digest(df).collect():
        want = brute(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[row.doc_id][:200]
        assert [s for s in row.spans.split(",") if s and not s.startswith("iban")] == want
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(w.startswith(k) for w in want) for k in RAW]


def test_iban_context_and_redaction(spark):
    df = spark.createDataFrame([(1, "pay to IBAN DE89 3704 0044 0532 0130 00 now", "k"), (2, "DE88370400440532013000", "k"), (3, "call +1 (555) 123-4567 or a@b.com", "k"), (4, None, "k"), (5, "ünï 4111 1111 1111 1111", "k")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    assert got[1].spans.endswith("iban:12:39") and got[2].n_iban == 0
    assert got[3].max_score > 0.75 and got[4].spans == "" and got[4].max_score == 0
    red = {r.doc_id: r for r in pii.redact(df).collect()}
    assert red[1].text == "pay to IBAN [IBAN] now" and red[3].text == "call [PHONE] or [EMAIL]" and red[4].text is None and red[5].text == "ünï [CARD]"
    assert red[1].spans == "k" and pii.redact(df).columns == df.columns
    assert pii.digest(df.limit(0)).count() == 0


def test_account_numbers_by_country(spark):
    texts = ["AT61 1904 3002 3457 3201 CALL NOW", "AT611904300234573201X", "NO93 8601 1117 947, BE68539007547034", "XX61 1904 3002 3457 3201", "AT61 1904 3002 3457 3202", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]
    got = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    iban = {i: [s for s in (x or "").split(",") if s.startswith("iban")] for i, x in got.items()}
    assert iban == {0: ["iban:0:24"], 1: [], 2: ["iban:0:18", "iban:20:36"], 3: [], 4: [], 5: ["iban:0:38"]}


def test_context_decides_what_is_redacted(spark):
    df = spark.createDataFrame([(1, "version 1.2.3.4 of the server 1.2.3.4")], "doc_id long, text string")
    assert pii.redact(df).first().text == "version 1.2.3.4 of the server [IP]"
    assert pii.redact(df, min_score=0).first().text == "version [IP] of the server [IP]"


def test_many_spans(spark):
    # places beyond one block of running sums, and stretches over several pieces
    import time

    r = random.Random(5)
    words = ["é" * 30, "x" * 3000, "a@b.cd", "+1 (555) 123-4567", "1.2.3.4", "ü 4111 1111 1111 1111 ", " 1.2.3.4@b.cd "]
    texts = [" ".join(r.choices(words, [20, 0.2, 5, 5, 5, 5, 5], k=n)) for n in (600, 1500, 4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {i: brute(t) for i, t in enumerate(texts)}
    assert {x.doc_id: x.spans.split(",") for x in pii.digest(df).collect()} == spans
    for x in pii.redact(df).collect():
        out, at = [], 0
        for s in spans[x.doc_id]:
            kind, a, b = s.split(":")
            if int(a) >= at:
                out.append(texts[x.doc_id][at : int(a)] + f"[{kind.upper()}]")
            at = max(at, int(b))
        assert x.text == "".join(out) + texts[x.doc_id][at:]
    took = []
    for n in (12_500, 100_000):
        one = spark.createDataFrame([(1, "mail someone at a@b.cd or 1.2.3.4 in good time and " * (n // 2))], "doc_id long, text string")
        start = time.time()
        assert pii.digest(one).first().n_email == n // 2
        took.append(time.time() - start)
    assert took[1] < 20 * took[0]


def test_redaction_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "mail a@b.co now", "n", 5)], "doc_id long, text string, _pii_note string, spans int")
    out = pii.redact(df)
    assert out.columns == ["doc_id", "text", "spans"] and out.first().text == "mail [EMAIL] now"
