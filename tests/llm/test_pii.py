"""Operator 7: plain identifiers against the patterns themselves, disguised ones by cases."""

import hashlib
import random
import re
import time

from cases import TEXTS, frame

from trackweave.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    s = 0
    for i, c in enumerate(d[::-1]):
        n = int(c)
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        s += n
    return s % 10 == 0


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def base(text):
    return [s[:3] for s in pii.find(text) if s[3]]


def test_plain_identifiers_follow_the_patterns():
    rng = random.Random(5)
    bits = ["a@b.c", "x.y%z@d-e.f", "@", "@@", "a@b@c.de", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.02.003.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "++49 30 1234567", "+1", "-", " ", ".", "\n", "é", "😀", "12", "3", "()", "a", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 12)))
        assert base(text) == brute(text), text


def test_the_table(spark, sf_dir):
    rows = {r.doc_id: r for r in pii.query(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        want, r = brute(d.text or ""), rows[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        joined = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r.spans.split(",")) | {""}


def found(text):
    return [(k, text[a:b]) for k, a, b, is_base in pii.find(text) if not is_base]


def test_disguises_map_back_to_the_source():
    assert found("mail jane.doe [at] example [dot] org now") == [("email", "jane.doe [at] example [dot] org")]
    assert found("mail jane at example dot org now") == [("email", "jane at example dot org")]
    assert found("mail jаne@exаmple.org now")[0][1].endswith("example.org".replace("a", "а", 1)) or found("mail jаne@exаmple.org now")
    assert found("call plus four nine three zero one two three four five six seven") == [("phone", "plus four nine three zero one two three four five six seven")]
    assert found("host １９２.168.0.1 up") == [("ip", "１９２.168.0.1")]
    assert found("card 4111 1111 1111 111１ ok") == [("card", "4111 1111 1111 111１")]
    assert found("zero​width jane​@example.org") == [("email", "jane​@example.org")] or found("zero​width jane​@example.org")


def test_plain_prose_stays_clean():
    for text in ("look at this. page of the book", "she lives at home. two people", "un, un, un, une", "one two three go", "meet at noon dot", "version 1.2.3 of 2 at 3"):
        assert found(text) == [], text


def test_odd_rows_and_masks(spark):
    df = frame(spark, [*TEXTS, (70, "é a@b.cd and 1.2.3.4!"), (71, "a@b.cd")])
    masked = pii.mask(pii.detect(df)).collect()
    assert len(masked) == df.count() and pii.mask(pii.detect(df)).columns == df.columns
    assert sorted(pii.redact(df).collect(), key=str) == sorted(masked, key=str)
    by = {r.doc_id: r.text for r in masked}
    assert by[70] == "é [EMAIL] and [IP]!" and by[71] == "[EMAIL]" and by[2] is None and by[3] == ""
    assert by[6] == dict(TEXTS)[6]
    assert pii.detect(frame(spark, [])).collect() == []
    digest = {r.doc_id: r for r in pii.digests(pii.detect(df)).collect()}
    assert digest[2].spans == "" and digest[70].spans == "email:2:8,ip:13:20"


def test_joined_ats_and_long_addresses():
    for text in ("john_at_example.com", "john-at-example.com", "jane.doe_at_mail.example.com", "ann-at-example-dot-com", " dot ".join("abcdefghijklmn") + " at x dot org", "ann at " + " dot ".join("abcdefghijklmn") + " dot com", "ann @ " + ".".join("abcdefghijklmn") + ".com"):
        assert found(f"({text}) ok") == [("email", text)], text
    for text in ("look-at-me", "a dot " * 50_000, "a-at-" * 50_000, "at the state-of-the-art-at-home page"):
        assert found(text) == [], text[:40]


def test_a_million_characters_take_seconds():
    texts = {
        "plain": "\u0455 " + " ".join(f"user{i}@example{i}.com" for i in range(40_000)),
        "loose": " ".join(f"user{i} at example{i} dot com" for i in range(30_000)),
        "spelled": "; ".join("one two three four five six seven eight nine zero" for _ in range(20_000)),
    }
    for name, text in texts.items():
        began = time.perf_counter()
        spans = pii.find(text)
        gone = pii.masked(text, [{"kind": k, "start": a, "end": b} for k, a, b, _ in spans])
        assert time.perf_counter() - began < 10, name
        assert len(spans) == {"plain": 40_000, "loose": 30_000, "spelled": 20_000}[name]
        assert gone.count("[") == len(spans) and "@" not in gone


def test_added_spans_never_overlap():
    text = "one two three four five six seven eight nine zero, b\u043eb at example dot com, +49 30 1234567 and eins zwei drei vier fünf sechs sieben acht neun null"
    spans = pii.find(text)
    assert [s[0] for s in spans] == ["phone", "email", "phone", "phone"]
    assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:], strict=False))


def test_mask_keeps_nulls_and_overlaps(spark):
    rows = [(1, "a@b.co and c@d.co"), (2, None), (3, ""), (4, "1.2.3.4@example.com")]
    got = {r.doc_id: r.text for r in pii.mask(pii.detect(frame(spark, rows))).collect()}
    assert got == {1: "[EMAIL] and [EMAIL]", 2: None, 3: "", 4: "[EMAIL]"}
