"""Groups of near copies about the threshold, and the packing encoder against the library."""

import random

import pyarrow as pa
from tokenizers import Tokenizer

from dealforge.llm import jaccard, packing, queries


def test_jaccard_of_copies_about_the_threshold(spark):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.choice([1, 2, 2, 3, 3])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    links = {(a, b) for b in range(260) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert 1000 < len(links) < 28000  # of 33670 pairs, so both sides of the threshold are met
    least = list(range(260))
    for _ in range(260):
        now = list(least)
        for a, b in links:
            now[a] = now[b] = min(now[a], now[b])
        if now == least:
            break
        least = now
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == dict(enumerate(least))


def test_packing_encoder_equals_the_library():
    path = queries.vocabulary(queries.PACK_MODEL)
    rng = random.Random(3)
    bits = [*"abAB'.,<|>-=_1 9\n\t é̸́İſªµक़ …—中ßﬁKſͅ　😀", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'ll", " ", " ", "word", "Word."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    ids, ends = packing.encoder(path)(pa.array([None, *texts]))
    library = Tokenizer.from_file(path)
    assert ends[1] == 0
    for text, a, b in zip(texts, ends[1:-1], ends[2:]):
        assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_jaccard_of_cut_and_extended_copies(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):  # pairs alone, of unequal size, about the threshold
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(20, 160))]
        cut = round(len(words) * rng.uniform(0.7, 0.9))
        at = rng.randint(0, len(words) - cut)
        other = words[at : at + cut] if i % 2 else words[:at] + [f"x{rng.randrange(10**6)}" for _ in range(len(words) - cut)] + words[at:]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    want = {}
    for i in range(0, 600, 2):
        linked = 100 * len(sets[i] & sets[i + 1]) >= 75 * len(sets[i] | sets[i + 1])
        want |= {i: i, i + 1: i if linked else i + 1}
    assert 60 < sum(k != v for k, v in want.items()) < 240
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want
