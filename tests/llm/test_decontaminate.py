"""Wu-Manber search against brute force."""

import random
import re

from corpus import benchmark, edge_docs, prose, rows

from sharelens.llm import decontaminate as dec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=13):
    words, hit, names = lowered(text), set(), set()
    for name, item in items:
        w = lowered(item)
        for i in range(max(1, len(w) - window + 1)) if w else []:
            part = w[i : i + window]
            for j in range(len(words) - len(part) + 1):
                if words[j : j + len(part)] == part:
                    hit |= set(range(j, j + len(part)))
                    names.add(name)
    return len(words), sorted(hit), names


def test_words():
    text = "Ab\x7f1.2—É x'Y\x00Z [q] ÄB"
    assert [w.decode() for w in dec.words_of(text)] == lowered(text)


def test_random_texts():
    rng = random.Random(3)
    for _ in range(300):
        items = [(str(i), " ".join(rng.choices("ab", k=rng.choice((0, 1, 2, 12, 13, 14, 30))))) for i in range(rng.randint(1, 4))]
        text = " ".join(rng.choices("abc" if rng.random() < 0.5 else "ab", k=rng.randint(0, 120)))
        search = dec.searchers([(n, dec.words_of(t)) for n, t in items])
        assert dec.hits(text, search) == brute(text, items)


def test_skips_most_words():
    search = dec.WuManber({tuple(dec.words_of(prose(13))): "x"})
    looked = []

    class Shift(dict):
        def get(self, key, default):
            looked.append(key)
            return super().get(key, default)

    search.shift = Shift(search.shift)
    assert not list(search.find([b"zzz"] * 1200)) and len(looked) <= 100


def test_blocks_agree_with_one_pass(spark):
    docs = edge_docs(spark)
    key = lambda r: (str(r.doc_id), r.n_words, r.n_hit, r.n_items, tuple(r.names), r.contaminated)
    whole = sorted(key(r) for r in dec.contamination(docs, benchmark(spark)).collect())
    parts = sorted(key(r) for r in dec.contamination(docs, benchmark(spark), block_bytes=60).collect())
    items = [("" if i is None else str(i), t) for i, t in ((r.item_id, r.text) for r in benchmark(spark).collect())]
    want = []
    for doc_id, text, *_ in rows():
        n, hit, names = brute(text, items)
        want.append((str(doc_id), n, len(hit), len(names), tuple(sorted(names)), bool(hit) and 20 * len(hit) >= n))
    assert whole == parts == sorted(want)
