import hashlib
import random
import re

from netloom.llm import pii
from tests.llm import cases

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, x in enumerate(map(int, reversed(digits))):
        total += sum(divmod(2 * x, 10)) if i % 2 else x
    return total % 10 == 0


def plain(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0])))


def test_base_spans_are_those_of_the_patterns():
    rnd = random.Random(1)
    bits = ["a@b.c", "@", ".", "x.y%z@d-e.org.uk", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+49", " ", "-", "é", "漢", "12", "007.008.009.010", "\n", "a", "+1.2.3.4", "5500005555555559"]
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(12)))
        assert [(s.kind, s.start, s.end) for s in pii.find(text) if s.kind in pii.BASE_KINDS] == plain(text)


def test_checksums_and_context_decide_the_other_kinds():
    good, bad = "DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 01"
    assert [s.kind for s in pii.find(f"pay to {good} now") if s.kind == "iban"] == ["iban"]
    assert not [s for s in pii.find(f"pay to {bad} now") if s.kind == "iban"]
    assert [s.kind for s in pii.find("my social security number 219-09-9999") if s.kind == "ssn"] == ["ssn"]
    assert not pii.find("part 219-09-9999")


def test_context_moves_the_score():
    near = lambda t: next(s.score for s in pii.find(t) if s.kind == "card")
    assert near("invoice 4111 1111 1111 1111") < near("xx 4111 1111 1111 1111") < near("credit card 4111 1111 1111 1111")


def test_account_numbers_end_where_their_country_says():
    for text, want in (("IBAN DE89 3704 0044 0532 0130 00 EUR", "DE89 3704 0044 0532 0130 00"), ("GB82 WEST 1234 5698 7654 32 BIC ABC", "GB82 WEST 1234 5698 7654 32"), ("to DE89370400440532013000 A note", "DE89370400440532013000"), ("DE89370400440532013000X", None), ("XX89370400440532013000", None)):
        found = [text[s.start : s.end] for s in pii.find(text) if s.kind == "iban"]
        assert found == ([want] if want else [])
    two = "NO93 8601 1117 947 BE68 5390 0754 7034"
    assert [two[s.start : s.end] for s in pii.find(two) if s.kind == "iban"] == ["NO93 8601 1117 947", "BE68 5390 0754 7034"]


def test_time_grows_with_the_text_alone():
    import time

    def took(text):
        began = time.process_time()
        pii.find(text)
        return time.process_time() - began

    for unit in ("a", "1", "1.", "1 ", "+1", "a@", "@a", "AA11"):
        short = min(took(unit * 50_000) for _ in range(3))
        assert took(unit * 400_000) < 24 * short + 0.2  # eight times the text


def test_query_columns(spark, tmp_path):
    data = cases.rows() + [(500, "mail a@b.cc and +1 (743) 555-3824, 4111111111111111 at 1.2.3.4 é")]
    cases.frame(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in pii.query(spark, str(tmp_path)).collect()}
    r = got[500]
    base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(data[-1][1]))
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans == base
    assert got[100].base_sha256 == hashlib.sha256(b"").hexdigest() and got[100].spans == ""
    assert pii.detect(cases.frame(spark, [])).count() == 0
