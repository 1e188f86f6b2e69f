import hashlib
import random
import re

from tests.llm.fixtures import documents, odd_rows, rows_of
from waybill.llm import op1_pii as op

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(m):
    return re.sub("[^0-9]", "", m.group())


def base(text):
    """The contract's patterns, one by one."""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and op.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    alphabets = ["ab@.@-+ 1", "0123456789 -..+", "0123. ", "+0123456789 ().-", "a@b.c1 +2%é漢", "0123456789 -", "012.5"]
    for _ in range(30_000):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(50)))
        assert [s for s in op.find_spans(text) if s[0] in op.BASE_KINDS] == base(text), text


def test_added_kinds_and_their_borders():
    text = "IBAN: DE89 3704 0044 0532 0130 00, ssn 123-45-6789, account no. 1234567, http://bob:pw@h/x http://[::1]/"
    kinds = {kind: text[s:e] for kind, s, e in op.find_spans(text)}
    assert kinds["iban"] == "DE89 3704 0044 0532 0130 00"
    assert kinds["ssn"] == "123-45-6789" and kinds["account"] == "1234567"
    assert kinds["userinfo"] == "bob:pw" and kinds["ipv6"] == "::1"
    clean = "iban DE00 0000, ssn 000-12-3456, accounting 12345678, accounts: none, see http://h/x"
    assert op.find_spans(clean) == []


def test_redacted_text_keeps_the_rest():
    text = "é a@b.co y +1 (988) 555-2485 z"
    assert op.redacted(text, op.find_spans(text)) == "é [EMAIL] y [PHONE] z"


def test_every_odd_row_comes_back(spark):
    rows = [*odd_rows(), (20, "🙂 mail me: a@b.co or 1.2.3.4", "en", "a", 1)]
    df = documents(spark, rows, clashing=True)
    found = op.detect(df).collect()
    assert len(found) == len(rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.spans == "" and r.base_sha256 == empty for r in found if r.doc_id != 20)
    hit = next(r for r in found if r.doc_id == 20)
    assert (hit.n_email, hit.n_ip, hit.spans) == (1, 1, "email:11:17,ip:21:28")
    clean = op.redact(df)
    assert clean.columns == df.columns and clean.count() == len(rows)
    assert clean.filter("doc_id = 20").first().text == "🙂 mail me: [EMAIL] or [IP]"
    assert rows_of(clean.filter("doc_id <> 20 OR doc_id IS NULL")) == rows_of(df.filter("doc_id <> 20 OR doc_id IS NULL"))


def test_empty_table(spark):
    assert op.detect(documents(spark, [])).count() == 0
    assert op.redact(documents(spark, [])).count() == 0


def test_an_authority_has_no_longest_length():
    for n in (100, 2_100, 300_000):
        spans = op.find_spans("see http://" + "u" * n + ":p@h/x")
        assert [s[0] for s in spans if s[0] == "userinfo"] == ["userinfo"]
