"""Phrase collocations against plain counts of every phrase."""

import collections
import random
import re

import pytest

from touchline.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, longest, least, top, subsumed=80):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    out = collections.defaultdict(list)
    for (lang, w), a in found.items():
        cut = min(((2000000 * a) // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        inside = lambda v: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
        if not any(other == lang and len(v) > len(w) and 100 * c >= subsumed * a and inside(v) for (other, v), c in found.items()):
            out[lang].append((-cut[0], -a, " ".join(w).encode(), f[lang, w[: cut[1]]], f[lang, w[cut[1] :]], cut[1]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s, k) for lang, x in out.items() for i, (s, a, p, l, r, k) in enumerate(sorted(x)[:top]))


def made(seed, texts=60):
    draw = random.Random(seed)
    words = ["the", "of", "and", "Über", "straße", "naïve", "a", "☃", "x-y", "re", "new", "york", "city", "hall", " ", "\x00", "i̇"]
    rows = []
    for i in range(texts):
        parts = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 30))) + draw.choice([".", "; ", "\n", "\t", " ", "?!", "\r\n", "\x0b"]) for _ in range(6)]
        rows.append(("New York City hall\t\tOF the " * draw.randint(0, 2) + "".join(parts), draw.choice(["en", "en", "de", None, "und", ""])))
    return rows + [(None, "en"), ("", "en"), (" .,;", "de"), ("   ", None), *[("new york city hall", "fr")] * 40, (" the" * 5000, "en"), ("a.b," * 4000, "de")]


@pytest.mark.parametrize("slab,map_bits", [(4 << 20, None), (900, 6), (3000, 9)])
def test_equals_plain_counts(spark, slab, map_bits):
    """Whole shards; many small ones with a map so full that nearly every phrase is a candidate."""
    rows = made(4)
    df = spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, n int, phrase string").repartition(5)
    got = collocations.collocations(spark, df, least=12, top=25, slab=slab, map_bits=map_bits).collect()
    assert sorted(map(tuple, got)) == plain(rows, 4, 12, 25)


def test_thresholds_and_lengths(spark):
    rows = made(9, 90)
    df = spark.createDataFrame(rows, "text string, lang string")
    for longest, least, subsumed in ((2, 30, 80), (3, 5, 100), (4, 40, 1)):
        got = collocations.collocations(spark, df, longest=longest, least=least, top=2000, subsumed=subsumed).collect()
        assert sorted(map(tuple, got)) == plain(rows, longest, least, 2000, subsumed)


def test_nothing_to_find(spark):
    for rows in ([], [(None, None)], [("one two three", "en")]):
        assert collocations.collocations(spark, spark.createDataFrame(rows, "text string, lang string")).count() == 0


def test_long_texts_are_cut_between_pieces():
    import pyarrow as pa

    text = "ab cd. " * 300 + "one piece without an end " * 40 + ". rest"
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array([text, "short. text"])], ["lang", "text"])
    found = [x for slab in collocations.slabs(iter([batch]), 200) for xs in slab.values() for x in xs]
    assert b"\xff".join(found) == (text + ".short. text").encode().translate(collocations.TABLE)
    assert sorted(len(x) for x in found)[-2:][0] <= 200 < max(map(len, found))
