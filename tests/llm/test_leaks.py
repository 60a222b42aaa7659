"""Leaks that a template search alone would miss."""

import pytest

from pagemill.llm import decontaminate

ITEMS = {
    1: "2, 4, 8, 16, 32, what comes next?",
    2: "12 7 19 4 88 61 35 90 14 23 77 5 46 31",
    3: "we met Ann Bob Carl Dora Emil Fritz Gina Hans Ida Jan Karl in town",
    4: "who wrote Faust",
}


def found(spark, items, docs, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.contamination(rows, bench, **options).collect()}


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}])
def test_verbatim_items_of_slots_and_short_ones_are_found(spark, options):
    docs = [(k, f"some words before {t} and some words after") for k, t in ITEMS.items()]
    docs += [(10, "3, 9, 27, 81, 243, what comes next?"), (11, "14 23 12 7 61 88 4 90 5 46 77 31 35 19"), (12, "who wrote this Faust")]
    got = found(spark, list(ITEMS.items()), docs, **options)
    assert set(got) == {(k, k) for k in ITEMS}
    assert all(r.kind == "exact" and r.coverage == 1 for r in got.values())


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}])
def test_repeated_rows_and_several_texts_of_an_item(spark, options):
    one, two, three, four = (" ".join(f"{x}{k}" for k in range(20)) for x in ("one", "two", "three", "four"))
    items = [(1, one)] * 5 + [(2, one), (2, two), (2, three), (2, four), (2, two)]
    got = found(spark, items, [(1, f"before {one} after"), (2, f"before {two} after"), (3, f"{two} and {three[:60]}")], **options)
    assert set(got) == {(1, 1), (1, 2), (2, 2), (3, 2)}
    assert all((r.matched, r.windows, r.coverage, r.kind) == (13, 13, 1, "exact") for r in got.values())


PLAIN_NAMES = set(decontaminate.FUNCTION_WORDS)


def plain_templates(text):
    """(words in lower case, kinds), by loops over characters."""
    import re
    import unicodedata

    out, last = [], 0
    for m in re.finditer(r"[^\W_]+", text):
        word, gap = m[0], text[last : m.start()]
        last, low = m.end(), m[0].lower()
        opens = not out or any(c in ".!?:;\n|\"(" for c in gap)
        number = word[0] in "0123456789" or low in decontaminate.NUMBER_WORDS
        cased = unicodedata.category(word[0]) == "Lu" and not (len(word) > 1 and "A" <= word[1] <= "Z")
        if number:
            kind = decontaminate.NUMBER
        elif cased and not (opens and low in PLAIN_NAMES):
            kind = decontaminate.NAME
        elif out and out[-1][1] == decontaminate.NUMBER and low in decontaminate.UNITS:
            kind = decontaminate.UNIT
        else:
            kind = decontaminate.PLAIN
        out.append((low, kind))
    return out


def plain_leaks(items, docs, k=8, least=0.3):
    """Contamination by comparing every window with every window."""
    out = {}
    for i, item in items:
        a = plain_templates(item)
        size = min(k, len(a))
        for d, doc in docs:
            b = plain_templates(doc)
            pairs = []
            loose, strict = set(), set()
            for p in range(len(a) - size + 1):
                x = a[p : p + size]
                few = size >= 5 and sum(kind > 0 for _, kind in x) * 2 <= size
                loose |= {p} if few else set()
                strict.add(p)
                for q in range(len(b) - size + 1):
                    y = b[q : q + size]
                    if few and sum(kind > 0 for _, kind in y) * 2 <= size and all(u == v if u else s == t for (s, u), (t, v) in zip(x, y)) and all(not v or u for (_, u), (_, v) in zip(x, y)):
                        pairs.append((p, [(s, t, u) for (s, u), (t, _) in zip(x, y) if u]))
                    if [s for s, _ in x] == [s for s, _ in y]:
                        pairs.append((p, []))
            votes = {}
            for _, slots in pairs:
                for s, t, _ in slots:
                    votes.setdefault(s, {}).setdefault(t, 0)
                    votes[s][t] += 1
            # where no value ties, the choice is plain
            best = {s: max(v, key=lambda t: v[t]) for s, v in votes.items()}
            tied = any(sorted(v.values())[-2:][0] == max(v.values()) and len(v) > 1 for v in votes.values())
            names = {s for _, slots in pairs for s, _, u in slots if u != decontaminate.NUMBER}
            crowd = {}
            for s in names:
                crowd.setdefault(best[s], []).append(s)
            back = {t: max(ss, key=lambda s: votes[s][t]) for t, ss in crowd.items()}
            tied |= any(len(ss) > 1 for ss in crowd.values())
            good = {p for p, slots in pairs if all(best[s] == t and (u == decontaminate.NUMBER or back[t] == s) for s, t, u in slots)}
            shares = [len(good & w) / len(w) for w in (loose, strict) if w]
            if not tied and shares and max(shares) >= least:
                out[d, i] = round(max(shares), 6)
            elif tied:
                out[d, i] = None
    return out


CASES = [
    (1, "Alice has 3 apples and gives two apples to Bob before the evening train leaves at 5 o'clock from Berlin"),
    (2, "Compute 3 + 4 * 5 - 6 / 7 + 8"),
    (3, "Anna Maria Lopez has 12 kg and Peter Paul Rubens has 15 kg left"),
    (4, "12 34 56 78 90 11 12 13 14"),
    (5, "Сколько яблок было у Маши если Петя съел три яблока и осталось 7 яблок у них вечером"),
    (6, "How many miles does Zoe run in 40 min if she runs 6 miles in the first hour and then rests"),
]


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}])
def test_templates_and_slots_against_all_windows(spark, options):
    import random

    r = random.Random(2)
    docs = [(k, f"some words before. {t} some words after") for k, t in CASES]
    docs += [
        (11, CASES[0][1].replace("Alice", "Zoe").replace("3", "14").replace("two", "nine").replace("Berlin", "Rome")),
        (12, CASES[0][1].replace("Alice", "Zoe").replace("Bob", "Zoe")),
        (13, CASES[5][1].replace("Zoe", "Max").replace("40", "55").replace("miles", "km")),
        (14, CASES[4][1].replace("Маши", "Оли").replace("Петя", "Ваня").replace("7", "9")),
        (15, "the quick brown fox jumps over the lazy dog and goes home"),
        (16, " ".join(r.sample(CASES[5][1].split(), 19))),
    ]
    got = found(spark, CASES, docs, **options)
    want = plain_leaks(CASES, docs)
    sure = {k: v for k, v in want.items() if v is not None}
    assert {k: round(x.coverage, 6) for k, x in got.items() if want.get(k, 0) is not None} == sure
    assert {(k, k) for k in range(1, 7)} | {(11, 1), (13, 6), (14, 5)} <= set(sure)
    assert all(got[k, k].kind == "exact" for k in range(1, 7)) and got[11, 1].kind == got[14, 5].kind == "reparameterised"


def test_filter_of_hashes(spark):
    import numpy as np

    h = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 3000)
    table = spark.createDataFrame([(int(x),) for x in h], "h long")
    maybe = decontaminate._filter(table)
    assert decontaminate._passes(maybe, h.view(np.uint64)).all()
    other = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 3000)
    assert decontaminate._passes(maybe, other.view(np.uint64)).mean() < 0.2
    packed = np.packbits(maybe, bitorder="little").view(np.uint64)
    assert (decontaminate._passes(packed, other.view(np.uint64)) == decontaminate._passes(maybe, other.view(np.uint64))).all()
