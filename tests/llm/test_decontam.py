import random
from collections import defaultdict

import regex
from tests.llm.conftest import prose

from tallyspark.llm import decontam

SF = "/root/testdata/sf0.001"
N, P, U = decontam.NUMBER, decontam.NAME, decontam.UNIT


def spaced(text):
    return regex.sub(r"[\x20\x09-\x0D]+", " ", text or "").strip(" ")


def template(text):
    text = regex.sub(r"(?<![\p{L}\p{N}])[$€£]?[-+]?\p{N}+(?:[.,:/]\p{N}+)*%?(?![\p{L}\p{N}])", N, text)
    text = regex.sub(rf"(?i)(?<={N}\x20)(?:{'|'.join(decontam.UNITS)})(?![\p{{L}}\p{{N}}])", U, text)
    text = regex.sub(r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}[\p{L}'-]*", P, text)
    return regex.sub(r"[^\p{L}\p{N}\x20⟨⟩]+", "", text).lower()


def in_step(text):
    s = spaced(text)
    return [(w, t) for w, t in zip(s.split(" "), template(s).split(" "), strict=True) if t]


def plain(text):
    bare = regex.sub(r"(?<![\p{L}\p{N}])[^\p{L}\p{N}\x20]+|[^\p{L}\p{N}\x20]+(?![\p{L}\p{N}])", "", spaced(text))
    return [w for w in bare.lower().split(" ") if w]


def bare(word):
    return regex.sub(r"[^\p{L}\p{N}]+", "", word.lower())


def consistency(filled, tokens):
    """filled: (token, item's word, document's word); whether the slots agree."""
    values, sources = defaultdict(set), defaultdict(set)
    for t, b, d in filled:
        values[t, b].add(d)
        sources[d].add((t, b))
    one = {k: len(v) == 1 and len(sources[next(iter(v))]) == 1 for k, v in values.items()}
    names = [k for k in values if k[0] == P]
    same = sum(one[k] and values[k] == {k[1]} for k in names)
    told = any(t == N for t, _ in values) or 2 * same >= len(names) or len(names) <= decontam.NAME_SHARE * tokens
    return sum(one.values()) >= decontam.CONSISTENCY * len(values) and told


def brute_force(docs, items):
    """(doc, item) pairs by the definition, one after the other."""
    out = set()
    for item, text in items:
        step, words = in_step(text), plain(text)
        if len(step) < decontam.LEAST_TOKENS:
            continue
        n, held = min(len(step), decontam.WINDOW), (N, P, U)
        cut = [(at, tuple(t for _, t in step[at : at + n])) for at in range(len(step) - n + 1)]
        marks = [(at, w, w, any(t in held for t in w)) for at, w in cut if sum(t not in held for t in w) >= decontam.LEAST_LITERALS]
        exact = not marks
        if exact:
            n = min(len(words), decontam.WINDOW)
            marks = [(at, tuple(words[at : at + n]), tuple(words[at : at + n]), False) for at in range(len(words) - n + 1)]
        marks += [(at, (bare(words[0]), *h[1:]), w, True) for at, h, w, s in marks if not exact and at == 0 and h[0] == P]
        for doc, body in docs:
            own = plain(body) if exact else [t for _, t in in_step(body)]
            at_of = defaultdict(list)
            for i in range(len(own) - n + 1):
                at_of[tuple(own[i : i + n])].append(i)
            met = [(d, at, w, s) for at, h, w, s in marks for d in at_of[h]]
            total = len({m[2] for m in marks})
            if not met or len({m[2] for m in met}) < decontam.COVERAGE * total:
                continue
            met.sort(key=lambda m: m[0] - m[1])
            runs = [[met[0]]]
            for a, b in zip(met, met[1:], strict=False):
                if (b[0] - b[1]) - (a[0] - a[1]) > decontam.SHIFT:
                    runs.append([])
                runs[-1].append(b)
            z = in_step(body)
            slots = lambda run, z=z, step=step: {(bt, bare(bw), bare(dw)) for d, b, _, s in run if s for (bw, bt), (dw, _) in zip(step[b : b + decontam.WINDOW], z[d : d + decontam.WINDOW], strict=False) if bt in held}
            found = {m[2] for run in runs if consistency(slots(run), len(step)) for m in run}
            if len(found) >= decontam.COVERAGE * total or consistency(slots(met), len(step)):
                out.add((doc, item))
    return out


def got(spark, docs, items):
    rows = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id) for r in rows.collect()}


def test_quotations_are_found_wherever_they_stand(spark):
    items = [(1, "How many days are in a leap year"), (2, "Which river runs through the old town"), (3, "Anna has 12 apples and 7 pears left")]
    heads = ["Question: ", "He asked, ", "and so ", "Well. ", "", "(", "they said \""]
    docs = [(10 * i + n, f"{h}{t}, then went on") for i, t in items for n, h in enumerate(heads)] + [(10 * i + 9, f"he wondered {t[0].lower()}{t[1:]}.") for i, t in items[:2]]
    docs += [(50, "Bert has 30 apples and 2 pears left"), (51, "How many days he stayed in a year of plenty"), (52, "the river runs through an old town")]
    want = {(d, d // 10) for d, _ in docs[:-3]} | {(50, 3)}
    assert got(spark, docs, items) == want == brute_force(docs, items)


def test_nouns_of_german_are_no_names(spark):
    items = [(1, "Der Hund und die Katze liegen auf dem Sofa"), (2, "Die Mutter kauft 3 Birnen und 12 Eier auf dem Markt")]
    docs = [(1, "Der Mann und die Frau liegen auf dem Bett"), (2, "Gestern: Der Hund und die Katze liegen auf dem Sofa."), (3, "Die Frau und der Hund liegen auf dem Weg"), (4, "Die Tante kauft 5 Birnen und 7 Eier auf dem Markt")]
    assert got(spark, docs, items) == {(2, 1), (4, 2)} == brute_force(docs, items)


def test_other_names_alone(spark):
    items = [(1, "the day before yesterday Anna walked along the river and met nobody until she saw Bert"), (2, "Anna sees Bert and Carl and Dora in the garden")]
    docs = [(1, "So the day before yesterday Zoe walked along the river and met nobody until she saw Yann"), (2, "Emil sees Fritz and Gerd and Hans in the garden"), (3, "Anna sees Bert and Carl and Hans in the garden")]
    assert got(spark, docs, items) == {(1, 1), (3, 2)} == brute_force(docs, items)


def test_rows_that_share_or_lack_an_id(spark):
    ask = "Tom bought {} red apples and {} green pears at the market this morning"
    items = [(1, ask.format(3, 5))]
    half = ask.format(8, 9).split()
    docs = [(1, "x " + ask.format(4, 4)), (1, ask.format(8, 9)), (None, ask.format(7, 2)), (2, " ".join(half[:6])), (2, " ".join(half[6:])), (3, ask.format(6, 1)), (3, ask.format(6, 1)), (4, None), (None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = sorted(((r.doc_id, r.item_id) for r in decontam.contaminated(frame, bench).collect()), key=str)
    assert rows == [(1, 1), (3, 1), (None, 1)]
    kept = sorted(((r.doc_id, r.text) for r in decontam.drop_contaminated(frame, bench).collect()), key=str)
    assert kept == sorted([docs[0], docs[3], docs[4], docs[7], docs[8]], key=str)


def test_small_tables_match_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_force([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == want and want


def test_planted_items_match_brute_force(spark):
    r = random.Random(8)
    names = ["Anna", "Bert", "Cleo", "Dan"]
    items = [(i, f"{r.choice(names)} {prose(i, r.randint(1, 9))} {r.randint(2, 99)} kg of {prose(50 + i, r.randint(2, 12))} {r.choice(['', r.choice(names) + ' 5'])}") for i in range(25)]
    docs = []
    for d in range(120):
        i, text = r.choice(items)
        words = text.split()
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(words))
            words[k] = {True: str(r.randint(2, 99)), False: r.choice(names)}.get(words[k].isdigit(), words[k]) if words[k].isdigit() or words[k] in names else r.choice([words[k], words[k] + "x"])
        docs.append((d, f"{prose(200 + d, r.randint(0, 20))} {' '.join(words)}. {prose(400 + d, 9)}" * r.randint(1, 2)))
    assert got(spark, docs, items) == brute_force(docs, items)


def test_a_long_text(spark):
    ask = "Tom bought 3 red apples and 5 green pears at the market this morning"
    docs = [(1, prose(5, 40_000) + " " + ask + " " + prose(6, 40_000))]
    assert got(spark, docs, [(1, ask)]) == {(1, 1)}
