"""Near-duplicates, repeated passages and leaks against brute force."""

import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quayline.llm import bitfilter, decontam, line_dedup, near_dup

from .conftest import prose


def shingle_set(text):
    """Shingles with the number of each occurrence: their Jaccard similarity is the weighted one."""
    w = re.findall(r"\w+", text.lower())
    seen = Counter()
    out = set()
    for k in range(max(1, len(w) - 4) if w else 0):
        s = tuple(w[k : k + 5])
        out.add((s, seen[s]))
        seen[s] += 1
    return out


def brute_classes(rows):
    rows = [(i, shingle_set(t or "")) for i, t in rows if i is not None]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s) in enumerate(rows):
        for j, t in rows[:k]:
            if s and t and len(s & t) >= 0.8 * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def test_classes_equal_brute_force(make, messy):
    rng, rows = random.Random(3), []
    for g in range(40):
        words = prose(100 + g, 150).split()
        rows.append((10 * g, " ".join(words), "en", "a"))
        for c in range(g % 4 * (1 if g else 0) + (60 if g == 5 else 0)):
            changed = list(words)
            for _ in range(rng.randint(0, 4)):
                changed[rng.randrange(len(changed))] = f"edit{rng.randint(0, 9999)}"
            rows.append((10_000 + 100 * g + c, " ".join(changed), "en", "a"))
    found = near_dup.near_duplicates(make(rows)).collect()
    got = {r["doc_id"]: r["class_id"] for r in found}
    assert got == brute_classes([r[:2] for r in rows])
    texts = {i: t for i, t, *_ in rows}
    for r in found:  # links lead to other texts of the class
        others = {texts[i] for i, c in got.items() if c == r["class_id"]} - {texts[r["doc_id"]]}
        assert min(1, len(others)) <= r["n_links"] <= len(others)
    out = near_dup.near_duplicates(messy).collect()
    assert len(out) == messy.count() and {r["class_id"] for r in out if r["doc_id"] in (2, 3, 4)} == {2, 3, 4}
    assert near_dup.near_duplicates(make([])).count() == 0


def test_links_within_form_letters_are_found(make):
    """Strangers on one form lie just below the threshold; pairs, and short letters of another form, above."""
    rng, rows = random.Random(4), []
    first, second = [[f"{c}{k}" for k in range(104)] for c in "vw"]

    def own(n):
        return [f"own{rng.randrange(10**12)}" for _ in range(n)]

    for g in range(400):
        words = own(10)
        rows.append((g, " ".join(first[:52] + words + first[52:]), "en", "a"))
        if g % 4 == 0:
            rows.append((1000 + g, " ".join(first[:52] + words[:8] + own(2) + first[52:]), "en", "a"))
    for g in range(120):
        cut = rng.choice([0, 0, 1, 3])  # some letters lack the form's last words
        rows.append((2000 + g, " ".join(second[:52] + own(rng.choice([5, 8, 9, 10])) + second[52 : 104 - cut]), "en", "a"))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(make(rows)).collect()}
    want = brute_classes([r[:2] for r in rows])
    assert got == want and len(set(want.values())) > 400


def test_weights_count_occurrences(make):
    """Sets of shingles that are alike, occurrences that are not; and the other way round."""
    verse, other = prose(50, 40).replace(".", ""), prose(51, 40).replace(".", "")
    rows = [
        (1, f"{verse} {verse} {verse}", "en", "a"),
        (2, f"{verse} {verse} {verse} {verse} {verse} {verse} {verse}", "en", "a"),
        (3, f"{other} " * 9 + prose(52, 30), "en", "a"),
        (4, f"{other} " * 9 + prose(53, 30), "en", "a"),
    ]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(make(rows)).collect()}
    assert got == brute_classes([r[:2] for r in rows]) == {1: 1, 2: 2, 3: 3, 4: 3}
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(make(rows), weighted=False).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_recall_of_planted_near_copies(make):
    """Pairs just above the threshold among many documents."""
    rng, rows, pairs = random.Random(8), [], 0
    for g in range(300):
        words = prose(9000 + g, 130).split()
        changed = list(words)
        for k in rng.sample(range(len(words)), 2):
            changed[k] = f"edit{rng.randint(0, 9999)}"
        rows += [(g, " ".join(words), "en", "a"), (1000 + g, " ".join(changed), "en", "a")]
    want = brute_classes([r[:2] for r in rows[:120]])
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(make(rows)).collect()}
    assert all(got[i] == c for i, c in want.items())
    pairs = sum(got[1000 + g] == g for g in range(300))
    assert pairs >= 290


def test_rows_not_ids_are_joined(make):
    """One id on two texts, null ids, ids above 2 ** 53: no text is lost and no id changes."""
    a, b, c = prose(60, 80), prose(61, 80), prose(62, 80)
    large = 2**53 + 1
    rows = [(5, a, "en", "a"), (5, b, "en", "a"), (7, b, "en", "a"), (8, a, "en", "a"), (None, c, "en", "a"), (large, c, "en", "a"), (large + 2, prose(63, 80), "en", "a"), (None, prose(64, 80), "en", "a")]
    docs = make(rows)
    out = sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in near_dup.near_duplicates(docs).collect())
    assert out == sorted([(5, 5), (5, 5), (7, 5), (8, 5), (0, large), (large, large), (large + 2, large + 2), (0, 0)])
    kept = near_dup.keep_one(docs.withColumn("_gone", docs["rank"]).withColumn("row", docs["rank"])).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(5, a), (5, b), (large, c), (large + 2, rows[6][1]), (0, rows[7][1])])


def test_one_of_each_class_stays(messy):
    kept = near_dup.keep_one(messy)
    assert kept.columns == messy.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 9]


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**63, 300).astype(np.uint64)
    wa, wb = rng.integers(1, 6, 300), rng.integers(1, 6, 300)
    text, element, weight = np.repeat([0, 1], 300), np.concatenate([e, e]), np.concatenate([wa, wb])
    s = near_dup.dart_signatures(text, element, weight, 2)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.15
    alone = near_dup.dart_signatures(text[:300], element[:300], weight[:300], 1)
    assert (alone[0] == s[0]).all()  # a signature doesn't depend on the batch


def _pieces(text, unit):
    """Units as tuples of words, cut by plain loops; and where each lies."""
    out = []
    for line in re.finditer(r"[^\n]+", text):
        words = [(m.group().lower(), line.start() + m.start(), line.start() + m.end()) for m in re.finditer(r"\w+", line.group())]
        if not words:
            continue
        if unit == "line" or len(words) < line_dedup.MIN_WORDS:
            out.append((unit != "line", words))
            continue
        marks = [line.start() + m.start() for m in re.finditer(r"[.!?]", line.group())]
        pieces, lo = [], 0
        for mark in [*marks, line.end()]:
            piece = [w for w in words[lo:] if w[1] < mark]
            lo += len(piece)
            pieces.append(piece)
        for piece in filter(None, pieces):
            cuts = set()
            if len(piece) > line_dedup.LONG:
                order = [int(line_dedup._mix(np.array([xxhash.xxh3_64_intdigest(w[0]) & ~7], np.uint64) ^ line_dedup._ODD)[0]) for w in piece]
                for k in range(len(piece) - line_dedup.REACH + 1):
                    cuts.add(min(range(k, k + line_dedup.REACH), key=lambda i: (order[i], -i)))
            lo = 0
            for k in sorted(cuts | {len(piece) - 1}):
                out.append((False, piece[lo : k + 1]))
                lo = k + 1
    return out


def brute_repeats(rows, unit="passage"):
    """Unit by unit in order of rank; a unit is compared by its words."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        runs, prev = [], None
        for k, (short, words) in enumerate(_pieces(t, unit)):
            key = (short, tuple(w[0] for w in words))
            if key in seen:
                one = (words[0][1], words[-1][2], len(words))
                if prev == k - 1:
                    runs[-1].append((short or unit == "line", one))
                else:
                    runs.append([(short or unit == "line", one)])
                prev = k
            seen.add(key)
        for run in runs:
            if sum(one[2] for _, one in run) >= line_dedup.MIN_WORDS:
                out.setdefault(i, set()).add((run[0][1][0], run[-1][1][1]))
            else:
                for whole, one in run:
                    if whole:
                        out.setdefault(i, set()).add(one[:2])
    return out


def found_repeats(docs, unit="passage"):
    out = {}
    for r in line_dedup.repeated_passages(docs, unit).collect():
        out.setdefault(r["doc_id"], set()).add((r["start"], r["end"]))
    return out


def test_repeats_equal_brute_force(make, messy):
    rng, shared, plain, rows = random.Random(5), prose(900, 70), prose(901, 60).replace(".", "").lower(), []
    lines = ["short line", "Another line of six words here", "ok", prose(902, 20)]
    for k in range(45):
        own = prose(k + 500, 80)
        cut = own.index(" ", len(own) // 2)
        if k % 3 == 0:
            own = own[:cut] + " " + shared + " " + own[cut:]
        if k % 5 == 0:  # in the middle of a sentence, no marks of its own
            own = own[:40] + " " + plain + " " + own[40:]
        if k % 4 == 0:
            own += "\n" + "\n".join(rng.sample(lines, 3)) + "\n" + prose(k + 700, 12)
        rows.append((k, own, "en", "a"))
    texts = [r[:2] for r in rows]
    for unit in ("passage", "line"):
        assert found_repeats(make(rows), unit) == brute_repeats(texts, unit)
    got = found_repeats(make(rows))
    texts = dict(texts)
    for k in range(45):
        covered = " ".join(texts[k][a:b] for a, b in got.get(k, ()))
        if k % 3 == 0 and k:
            assert sum(w in covered for w in shared.split()) >= 55
        if k % 5 == 0 and k:
            assert sum(w in covered for w in plain.split()) >= 40
    assert {r["doc_id"] for r in line_dedup.repeated_passages(messy).collect()} <= {8, 9}
    assert line_dedup.repeated_passages(make([])).count() == 0


def test_repeated_lines_go_at_any_length_and_rows_stay_apart(make):
    line = "four words stand here"
    rows = [(k, f"{prose(40 + k, 20)}\n{line}\n{prose(50 + k, 20)}", "en", "a") for k in range(6)]
    out = line_dedup.repeated_passages(make(rows)).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 2, 3, 4, 5] and all(rows[r["doc_id"]][1][r["start"] : r["end"]] == line for r in out)
    # one id on two texts, a null id, an id above 2 ** 53
    big, text = 2**53 + 1, prose(70, 40)
    rows = [(5, prose(71, 30), "en", "a"), (5, prose(72, 30) + "\n" + text, "en", "a"), (big, text, "en", "a"), (None, prose(73, 10) + "\n" + text, "en", "a")]
    docs = make(rows).withColumn("removed", F.col("rank")).withColumn("row", F.col("rank"))
    assert sorted(r["doc_id"] for r in line_dedup.repeated_passages(docs).collect()) == [5, big]
    kept = line_dedup.remove_repeats(docs)
    assert kept.columns == docs.columns
    out = {(r["doc_id"], r["text"].strip()) for r in kept.collect()}
    assert (None, rows[3][1]) in out and (5, rows[0][1]) in out and len(out) == 4
    assert sum(text.rstrip(".") in t for _, t in out) == 1


def test_removal_keeps_the_first_and_the_offsets(make):
    first, other = prose(1, 40), prose(2, 40)
    out = {r["doc_id"]: r for r in line_dedup.remove_repeats(make([(1, first, "en", "a"), (2, other + "\n" + first, "en", "a")])).collect()}
    assert out[1]["text"] == first and out[1]["removed"] is None
    assert out[2]["text"].startswith(other.rstrip(".")) and len(out[2]["text"]) < len(other) + 5 and out[2]["removed"]


def test_bit_filter_passes_all_members(spark):
    members = [2**60 + 12345 * k for k in range(500)]
    bits = bitfilter.build(spark.createDataFrame([(m,) for m in members], "h long"), "h", 1 << 20)
    assert bitfilter.passes(bits, np.array(members, np.uint64)).all()
    others = np.arange(1, 100_000, dtype=np.uint64) * np.uint64(7919)
    assert bitfilter.passes(bits, others).mean() < 0.01


def test_leaks_verbatim_and_with_other_slots(spark, make, messy):
    item = "A train leaves the station at 14 and travels 120 km to reach Old Harbour before noon. How many km does the train travel if Old Harbour lies 120 km away and the clock shows 14 again?"
    swapped = item.replace("14", "9").replace("120", "300").replace("Old Harbour", "New Haven")
    broken = item.replace("120", "300", 1).replace("14", "9", 1)
    rows = [(1, prose(1, 50) + " " + item, "en", "a"), (2, prose(2, 50) + ". " + swapped + " " + prose(3, 30), "en", "a"), (3, prose(4, 90), "en", "a"), (4, broken, "en", "a")]
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "12 13 14")], "item_id long, text string")
    out = {r["doc_id"]: r for r in decontam.find_leaks(make(rows), bench).collect()}
    assert set(out) == {1, 2}  # 4 gives one value of the item two values
    assert out[1]["changed"] == 0 and out[2]["changed"] == 3
    kept = decontam.drop_leaks(make(rows), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4]
    assert decontam.find_leaks(messy, bench).count() == 0
    assert decontam.drop_leaks(messy, bench).count() == messy.count()
    assert decontam.find_leaks(make(rows), bench.limit(0)).count() == 0


def test_leaks_with_another_opening_name_short_items_and_null_ids(spark, make):
    item = "Tom has 5 apples. Tom buys 3 more. How many apples does Tom have?"
    swapped = item.replace("Tom", "Mary").replace("5", "8").replace("3", "6")
    rows = [
        (1, prose(1, 50) + ". " + swapped, "en", "a"),
        (None, prose(2, 50) + ". " + item, "en", "a"),
        (3, "Guide On How To Count. " + item, "en", "a"),  # an opening word that is a name elsewhere
        (4, "Mary has 5 apples. Mary buys 3 more. How many apples does Tom have?", "en", "a"),  # one name became two
        (5, prose(3, 40) + " grault snib florp " + prose(4, 20), "en", "a"),
        (6, prose(5, 40) + " grault snib " + prose(6, 20), "en", "a"),
        (7, "blarn", "en", "a"),
        (8, prose(7, 20) + " blarn", "en", "a"),
    ]
    bench = spark.createDataFrame([(1, item), (2, "grault snib florp"), (3, "blarn")], "item_id long, text string")
    docs = make(rows).withColumnRenamed("value", "_leaked")
    out = sorted((r["doc_id"] or 0, r["item_id"]) for r in decontam.find_leaks(docs, bench).collect())
    assert out == [(0, 1), (1, 1), (3, 1), (5, 2), (7, 3)]
    assert sorted(r["doc_id"] for r in decontam.drop_leaks(docs, bench).collect()) == [4, 6, 8]


def brute_leaks(rows, items):
    """Every document against every item, window by window and slot by slot, without hashes."""
    token = re.compile(r"\w+(?:[.,]\d+)*|[.!?\n]")

    def read(text, both):
        found, out, opens = token.findall(text), [], True
        inside, starts = set(), True
        for w in found:
            if w in ".!?\n":
                starts = True
                continue
            if w[0].isupper() and w[1:] == w[1:].lower() and not starts:
                inside.add(w.lower())
            starts = False
        for w in found:
            if w in ".!?\n":
                opens = True
                continue
            if any(c.isdigit() for c in w):
                t = ("#number", w.lower())
            elif w.lower() in decontam.UNITS and out and out[-1][0] == "#number":
                t = ("#unit", w.lower())
            elif w[0] != w[0].lower() and w[1:] == w[1:].lower() and (not opens or (both and w.lower() in inside)):
                t = ("#name", w.lower())
            else:
                t = (w.lower(), None)
            if t[0] == "#name" and out and out[-1][0] == "#name":
                out[-1] = ("#name", out[-1][1] + " " + t[1])
            else:
                out.append(t)
            opens = False
        return out

    out = set()
    for i, text in rows:
        for j, item in items:
            for both in (False, True):
                d, b = read(text, both), read(item, both)
                at = {}
                for k in range(len(d) - 4):
                    at.setdefault(tuple(t for t, _ in d[k : k + 5]), []).append(k)
                windows = {}
                for k in range(len(b) - 4):
                    w = tuple(t for t, _ in b[k : k + 5])
                    if any(t[0] != "#" for t in w):
                        windows.setdefault(w, []).append(k)
                held = [w for w in windows if w in at]
                if not windows or len(held) < 0.8 * len(windows):
                    continue
                shifts = Counter(x - k for w in held for k in windows[w] for x in at[w])
                shift = max(shifts, key=lambda s: (shifts[s], -s))
                values = {}
                for w in held:
                    for k in windows[w]:
                        if k + shift in at[w]:
                            for z in range(5):
                                if b[k + z][1] is not None:
                                    values.setdefault(b[k + z], set()).add(d[k + shift + z][1])
                if all(len(v) == 1 for v in values.values()):
                    out.add((i, j))
    return out


def test_leaks_equal_brute_force(spark, make):
    rng, items, rows = random.Random(21), [], []
    names = ["Anna", "Boris", "Clara", "Dmitri"]
    for j in range(12):
        words = prose(7000 + j, 24).lower().replace(".", "").split()
        words[3], words[9], words[10], words[15], words[20] = "NAME", "NUM", "km", "NAME", "NUM"
        items.append((j, " ".join(words)))
    filled = [(j, t.replace("NAME", names[j % 4]).replace("NUM", str(10 + j))) for j, t in items]
    for i in range(120):
        j = rng.randrange(12)
        t = items[j][1].replace("NAME", rng.choice(names)).replace("NUM", str(rng.randint(1, 99)))
        if i % 5 == 1:
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        if i % 5 == 2:
            t = t.replace(" km", " " + rng.choice(["miles", "km", "apples"]))
        if i % 7 == 3:
            t = re.sub(r"\d+", lambda m: str(rng.randint(1, 99)), t)
        if i % 4:
            t = prose(8000 + i, rng.randint(5, 60)) + rng.choice([" ", ". "]) + t + " " + prose(8500 + i, 20)
        rows.append((i, t if i % 6 else prose(8800 + i, 50), "en", "a"))
    bench = spark.createDataFrame(filled, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(make(rows), bench).collect()}
    want = brute_leaks([r[:2] for r in rows], filled)
    assert got == want and 30 < len(want) < 110


def test_spans_come_from_one_split():
    texts = ["", "one two. three\nfour", "  ünï ,, Δx!? \n\n z_9 ", "a b c d e f g h i j k l m n o p q r s t u v w x y z"]
    apart = [line_dedup.APART.split(t) for t in texts]
    found = line_dedup.units([p[1::2] for p in apart], line_dedup._Tokens(), "passage")
    starts, ends = line_dedup._spans(apart, found)
    spans = [[m.span() for m in line_dedup.TOKEN.finditer(t)] for t in texts]
    assert list(starts) == [spans[k][i][0] for k, i in zip(found["text"], found["first"])]
    assert list(ends) == [spans[k][i][1] for k, i in zip(found["text"], found["last"])]
