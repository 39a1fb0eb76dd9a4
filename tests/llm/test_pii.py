import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import pii
from tests.llm.cases import documents, row

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    found = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


def base(text):
    return [f"{k}:{a}:{b}" for a, b, k, _ in pii.spans(text) if k in pii.BASE]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1205.@+-_% ()é\n", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert base(text) == brute(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4111-1111 1111-1111", "10.0.0.256", "1.2.3.4.5.6.7.8", "+1 (212) 555-0100", "a@b.c@d.e", "x", " ", "@", ".", "+", "5500005555555559"]), max_size=8))
def test_base_spans_of_planted_text(parts):
    text = "".join(parts)
    assert base(text) == brute(text)


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")
    kinds = lambda t: [k for _, _, k, _ in pii.spans(t)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32.") == ["iban"]
    assert kinds("number 123456789 here") == [] and kinds("passport 123456789 here") == ["account"]
    assert kinds('token = "681c09b8e90e7e8c9575180f595f646cf2969054"') == ["token"] and kinds("681c09b8e90e7e8c9575180f595f646cf2969054") == []
    near, far = pii.spans("call +1 212 555 0100")[0][3], pii.spans("and +1 212 555 0100")[0][3]
    assert near > far


def test_long_runs_are_fast():
    for text in ("a" * 300_000, "1" * 300_000, "+1(" * 100_000, "a@" * 100_000, "1." * 150_000):
        pii.spans(text)


def test_find_and_redact(spark):
    rows = [row(1, None), row(2, ""), row(None, "mail a@b.co"), row(3, "mail a@b.co"), row(3, "mail a@b.co"), row(4, "😀 10.0.0.1, 4111 1111 1111 1111")]
    got = pii.find(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].spans == "" and by[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[4].spans == "ip:2:10,card:12:31" and (by[4].n_ip, by[4].n_card) == (1, 1)
    masked = pii.redact(documents(spark, rows))
    assert masked.columns == documents(spark, rows).columns
    assert sorted(str(r.text) for r in masked.collect()) == sorted(["None", "", *["mail <email>"] * 3, "😀 <ip>, <card>"])
    assert pii.find(documents(spark, [])).count() == 0 and pii.redact(documents(spark, [])).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: hashlib.sha256(",".join(brute(r.text or "")).encode()).hexdigest() for r in docs.collect()}
    assert {r.doc_id: r.base_sha256 for r in pii.find(docs).collect()} == want
