"""Operator 5 on planted questions."""

import random
import re
from collections import Counter

from cases import frame

from trackweave.llm import decontamination as d

ITEM = "A train leaves Springfield at 9 and travels 120 miles before the driver meets Maria. How many miles did the train of Maria travel after 9 in total, if it covers 120 miles?"


def found(spark, rows, items=((7, ITEM),)):
    bench = spark.createDataFrame(list(items), "item_id bigint, text string")
    docs = frame(spark, rows)
    out = d.leaks(docs, bench)
    return {(r.doc_id, r.item_id): r for r in out.collect()}, sorted(str(r.doc_id) for r in d.clean(docs, out).collect())


def test_exact_and_reparameterised(spark):
    filler = "some quiet words about rivers and stones that nobody has asked about in any known question so far "
    other = ITEM.replace("120", "340").replace("9", "7").replace("Springfield", "Dover").replace("Maria", "Jonas").replace("miles", "yards")
    mixed = ITEM.replace("120 miles?", "55 km?").replace("after 9", "after 4")
    rows = [(1, filler * 30 + ITEM + " " + filler * 4), (2, filler + "Now. " + other), (3, filler * 3), (4, None), (5, ""), (None, filler + ITEM), (1, filler * 2), (6, ITEM.upper()), (8, mixed), (9, ITEM), (9, ITEM)]
    got, kept = found(spark, rows)
    assert got[1, 7].kind == "exact" and got[None, 7].kind == "exact" and got[9, 7].coverage == 1
    assert got[2, 7].kind == "reparameterised" and got[2, 7].coverage == 1
    assert (3, 7) not in got and (4, 7) not in got
    assert (6, 7) not in got or got[6, 7].n_matched < got[1, 7].n_matched
    assert got[8, 7].n_matched < got[1, 7].n_matched  # the windows with other values don't count
    assert kept.count("1") == 1 and {"3", "4", "5"} <= set(kept) and "None" not in kept and "2" not in kept


def test_inconsistent_slots_are_dropped(spark):
    item = "first take 3 cups and stir 3 times then wait 3 hours and add 3 eggs to the 3 pots on the table"
    good = item.replace("3", "5")
    bad = "first take 3 cups and stir 8 times then wait 2 hours and add 9 eggs to the 7 pots on the table"
    got, _ = found(spark, [(1, good), (2, bad)], [(1, item)])
    assert got[1, 1].kind == "reparameterised" and got[1, 1].coverage == 1
    assert (2, 1) not in got


def template(text):
    """(kind, value) of each word, by rules written anew: numbers, units and names are slots."""
    out, opens = [], True
    for raw in (text or "").encode().split():
        word = raw.decode()
        core = re.sub(r"[^\w%°]+$", "", re.sub(r"^[^\w%°$€£+-]+", "", word)) if not word.isalpha() else word
        ends = re.sub("[\"')\\]»”’]+$", "", word)[-1:] in set(".!?:")
        if not any(c.isalnum() for c in core) and core.lower() not in d.UNITS:
            continue
        value = core.lower()
        number = re.fullmatch(r"[$€£+-]*\d[\d.,:/]*%?(?:st|nd|rd|th)?", core)
        if number:
            out.append(("#", value))
        elif value in d.UNITS and (len(value) >= 4 or (out and out[-1][0] == "#")):
            out.append(("u", value))
        elif value not in d.UNITS and not opens and core[0].isupper() and core[1:].islower():
            out.append(("n", value))
        elif value in d.UNITS and core[0].isupper() and core[1:].islower() and not opens:
            out.append(("n", value))
        else:
            out.append(("w", value))
        opens = bool(ends)
    return out


def windows_of(words):
    return [(i, tuple(words[i : i + 8])) for i in range(max(1, len(words) - 7))] if words else []


def shape(window):
    plain = sum(k == "w" for k, _ in window) >= min(4, len(window))
    return plain, tuple(v if k == "w" else k for k, v in window) if plain else window


def consistent(matches):
    """Places whose values are the usual ones, each of the item's values having one; ties go to the item's own, then the largest."""
    votes = {}
    for _, mine, theirs in matches:
        for a, b in zip(mine, theirs, strict=True):
            votes.setdefault(a, Counter())[b] += 1
    usual = {a: max(c, key=lambda b: (c[b], a == b, b)) for a, c in votes.items()}
    return {p for p, mine, theirs in matches if all(usual[a] == b for a, b in zip(mine, theirs, strict=True))}


def test_brute_force_on_the_table(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    slots = lambda w: [v for k, v in w if k != "w"]
    items = {r.item_id: windows_of(template(r.text)) for r in bench.collect()}
    index, holders = {}, {}
    for i, ws in items.items():
        for p, w in ws:
            index.setdefault(shape(w), []).append((i, p, slots(w)))
            holders.setdefault(shape(w), set()).add(tuple(shape(x)[1] for _, x in ws))
    want = set()
    for r in docs.collect():
        hits = {}
        for at, w in windows_of(template(r.text)):
            for i, p, theirs in index.get(shape(w), ()):
                if len(holders[shape(w)]) <= d.COMMON:
                    hits.setdefault(i, []).append((at, p, theirs, slots(w)))
        for i, rows in hits.items():
            groups, last, turn = {-1: rows}, None, 0
            for row in sorted(rows, key=lambda x: x[0] - x[1]):
                off = row[0] - row[1]
                turn += last is not None and off - last > d.MOVED
                groups.setdefault(turn, []).append(row)
                last = off
            own = [p for p, w in items[i] if len(holders[shape(w)]) <= d.COMMON]
            n = max(len(consistent([(p, a, b) for _, p, a, b in g])) for g in groups.values())
            if n >= min(d.SHARE * len(own), d.MANY):
                want.add((r.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in d.query(spark, sf_dir).collect()}
    assert got == want and len(got) >= 3


def test_an_instruction_of_all_items_makes_no_leak(spark):
    """Rows stay linear in documents and items, and a question with the instruction is found."""
    say = "read the following passage with care and then answer the question below in one short sentence of your own. "
    rng = random.Random(9)
    vary = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(24))
    items = [(i, say + vary()) for i in range(60)]
    docs = [(i, say + vary()) for i in range(60)]
    got, kept = found(spark, [*docs, (100, vary() + " " + items[7][1])], items)
    assert set(got) == {(100, 7)} and got[100, 7].coverage == 1 and len(kept) == 60


def invented(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_a_passage_that_many_items_share_is_found(spark):
    """No number of items that hold a window drops it: a passage asked about by 20 items is a leak of each, also in a benchmark of these alone."""
    rng = random.Random(10)
    passage = invented(rng, 40)
    items = [(i, passage + " " + invented(rng, 12)) for i in range(20)]
    docs = [(1, invented(rng, 30) + " " + passage + " " + invented(rng, 30)), (2, invented(rng, 60)), (3, invented(rng, 9) + " " + items[4][1])]
    for others in ([], [(100 + i, invented(rng, 30)) for i in range(30)]):
        got, kept = found(spark, docs, items + others)
        assert set(got) == {(d, i) for d in (1, 3) for i in range(20)} and kept == ["2"]
        assert got[1, 0].n_matched == 33 and got[1, 0].n_windows == 45 and got[3, 4].coverage == 1


def test_a_short_text_of_a_minority_of_items_counts(spark):
    """What 20 of 50 items share is no instruction, though it is the smaller part of each."""
    rng = random.Random(11)
    shared = invented(rng, 18)
    items = [(i, shared + " " + invented(rng, 24)) for i in range(20)] + [(100 + i, invented(rng, 30)) for i in range(30)]
    got, kept = found(spark, [(1, invented(rng, 30) + " " + shared), (2, invented(rng, 30))], items)
    assert set(got) == {(1, i) for i in range(20)} and got[1, 0].n_matched == 11 and kept == ["2"]


def windows_held(items, text):
    """Places of each item's windows that a text holds with consistent values, and of how many windows, whoever else holds them."""
    mine = windows_of(template(text))
    slots = lambda w: [v for k, v in w if k != "w"]
    at = {}
    for p, w in mine:
        at.setdefault(shape(w), []).append((p, slots(w)))
    return {i: (consistent([(p, slots(w), b) for p, w in ws for _, b in at.get(shape(w), ())]), len(ws)) for i, ws in ((i, windows_of(template(t))) for i, t in items)}


def test_no_document_is_lost_to_an_instruction(spark):
    """Windows of an instruction count like others: alone as one row of the document, beside others of the item with these."""
    rng = random.Random(13)
    say = invented(rng, 9) + " 4 or 5 " + invented(rng, 9)
    words, said = say.split(), 14  # windows
    items = [(i, say + " " + invented(rng, 24 + i % 3 * 8)) for i in range(24)] + [(100 + i, invented(rng, 30)) for i in range(9)]
    piece = lambda i, n: " ".join(items[i][1].split()[21 : 21 + n])
    rows = [(0, invented(rng, 20) + " " + say + " " + invented(rng, 20)), (1, say.replace("4", "7"))]
    rows += [(2, items[7][1]), (3, " ".join(words[:12]) + " and " + piece(5, 11) + " " + invented(rng, 5)), (4, " ".join(words[:12])), (5, piece(5, 11))]
    rows += [(6, " ".join(words[:14]) + " and " + piece(6, 8)), (7, " ".join(words[:15]) + " " + invented(rng, 5)), (8, say + " and " + piece(8, 8)), (9, invented(rng, 40))]
    for k in range(10, 60):
        i, a, n = rng.randrange(24), rng.randrange(6), rng.randrange(6, 18)
        rows.append((k, " ".join(words[a : a + rng.randrange(6, 18)]) + " and " + piece(i, n) + " " + invented(rng, 9)))
    out = d.links(frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    got, heard = {(int(r.doc_id), r.item_id) for r in out if r.kind != "instruction"}, {int(r.doc_id) for r in out if r.kind == "instruction"}
    for k, text in rows:
        enough = {i for i, (places, n) in windows_held(items, text).items() if len(places) >= min(d.SHARE * n, d.MANY)}
        alone = {i for i, (places, n) in windows_held(items, text).items() if i < 100 and len({p for p in places if p >= said}) >= min(d.SHARE * (n - said), d.MANY)}
        assert (k in heard) == (len(next(iter(windows_held(items[:1], text).values()))[0] & set(range(said))) >= 8)
        assert {i for j, i in got if j == k} == alone | (set() if k in heard else enough), k
        assert not enough or k in heard or enough <= {i for j, i in got if j == k}
    assert {0, 1, 2, 7, 8} <= heard and {(2, 7), (3, 5), (6, 6)} <= got and not {3, 6} & heard and not {4, 5, 9} & (heard | {k for k, _ in got})
    whole = next(r for r in out if r.doc_id == 2 and r.item_id == 7)
    assert whole.coverage == 1 and whole.n_windows == said + 24 + 7 % 3 * 8 and whole.kind == "exact"
    assert {r.item_id for r in out if r.kind == "instruction"} == {0} and sum(r.kind == "instruction" for r in out) == len(heard)


def test_items_of_one_template_are_one_class(spark):
    item = "first take {} cups of flour and stir {} times then wait and add {} eggs to the bowl on the old table"
    items = [(i, item.format(i + 2, i + 40, i + 90)) for i in range(40)]
    docs = [(i, item.format(i + 200, i + 300, i + 400)) for i in range(40)] + [(77, items[13][1]), (78, "so: " + items[20][1])]
    got, kept = found(spark, docs, items)
    assert len(got) == 42 and kept == []
    assert {i for k, i in got if k < 40} == {0} and got[77, 13].kind == "exact" and got[78, 20].kind == "exact" and got[5, 0].kind == "reparameterised"
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    members = d.classes_of(bench)[0]
    assert members.count() == 40 and members.select("class").distinct().count() == 1 and {r.of for r in members.collect()} == {0}


def test_number_heavy_items_with_other_numbers(spark):
    item = "Compute 12 + 35 * 7 - 4 / 2 = 9 km at 30 mph for 45 min"
    other = "Compute 83 + 21 * 6 - 5 / 3 = 8 km at 50 mph for 25 min"
    units = other.replace("km", "kg")
    part = "Compute 83 + 21 * 6 - 5 / 3 = 8 km"
    filler = "some quiet words about rivers and stones that nobody has asked about "
    got, kept = found(spark, [(1, filler + item), (2, filler * 2 + other + " " + filler), (3, filler + units), (4, filler + part), (5, "1 2 3 4 5 6 7 8 9 kg at 3 m for 2 h"), (6, other.replace("50 mph", "50 slow mph"))], [(1, item)])
    assert set(got) == {(1, 1), (2, 1)} and got[1, 1].kind == "exact" and got[2, 1].kind == "reparameterised" and got[2, 1].coverage > 0.8


def test_texts_that_share_an_id_are_kept_apart(spark):
    one, two = ITEM, ITEM.replace("120", "340").replace("Maria", "Jonas")
    other = "please sort the following seven words by the number of vowels that they hold and name the third of them"
    for items in ([(7, one), (7, two)], [(7, two), (7, one), (7, other)]):
        got, _ = found(spark, [(1, one), (2, two), (3, other)], items)
        assert got[1, 7].kind == "exact" and got[2, 7].kind == "exact" and ((3, 7) in got) == (len(items) == 3)


def test_empty_tables(spark):
    docs = frame(spark, [])
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert d.leaks(docs, bench).collect() == []
    assert d.leaks(frame(spark), bench).collect() == []
    assert d.clean(frame(spark), d.leaks(frame(spark), bench)).count() == frame(spark).count()


def test_short_items_inside_longer_texts(spark):
    filler = "some quiet words about rivers and stones that nobody has asked about "
    got, kept = found(spark, [(1, filler + "so what is the capital of France today " + filler), (2, filler * 2), (3, "What is the capital of France?"), (4, filler + "take 3 spoons daily"), (5, filler + "take 5 spoons daily")], [(1, "What is the capital of France?"), (2, "Take 3 spoons daily"), (3, "???")])
    assert set(got) == {(1, 1), (3, 1), (4, 2)} and kept == ["2", "5"]
    assert got[3, 1].coverage == 1 and got[4, 2].kind == "exact"


def test_items_of_little_but_numbers_match_word_for_word(spark):
    filler = "some quiet words about rivers and stones that nobody has asked about "
    item = "12 + 7 = 19 km, 30 45 60 75 km or 90 105 120 135 km"
    got, _ = found(spark, [(1, filler + item + " " + filler), (2, filler + item.replace("7", "8").replace("5", "6") + " " + filler), (3, filler)], [(1, item)])
    assert set(got) == {(1, 1)} and got[1, 1].kind == "exact" and got[1, 1].coverage == 1


def test_copies_with_other_numbers_each(spark):
    item = "first take 3 cups of flour and stir 4 times then wait and add 5 eggs to the bowl on the old table"
    sheet = " ".join(item.replace("3", str(10 + k)).replace("4", str(30 - k)).replace("5", str(50 + 7 * k % 20)) + "." for k in range(6))
    mixed = item.replace("3", "8") + ". " + item.replace("3", "9")
    got, kept = found(spark, [(1, sheet), (2, mixed), (3, item + ". " + sheet)], [(1, item)])
    assert set(got) == {(1, 1), (2, 1), (3, 1)} and all(r.coverage == 1 for r in got.values()) and kept == []
    assert got[1, 1].kind == "reparameterised" and got[3, 1].kind == "exact"


def test_copies_of_a_short_item_with_other_numbers_each(spark):
    item = "please add 5 and then add 7 to the sum"
    sheet = " ".join(item.replace("5", str(k)).replace("7", str(90 - k)) + "." for k in (11, 22, 33, 44))
    got, _ = found(spark, [(1, sheet)], [(1, item)])
    assert got[1, 1].coverage == 1
