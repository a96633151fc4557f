"""The ten operators against brute force, round trips and held-out accuracy; edge rows in every one."""

import collections
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import exactdedup, linededup, mixing, pieces, quality, queries, sharding, simhash, substrings, toxicity, warc
from touchline.llm.common import connected_components

PROSE = "the quick brown fox jumps over the lazy dog and runs far away from the old house near the river bank "
LINES = "\n".join(f"line number {i} of a shared passage" for i in range(6))
ROWS = [
    (1, PROSE * 3, "a"), (2, PROSE * 3, "a"), (3, (PROSE * 3).upper(), "b"), (4, None, None), (5, "", "b"), (6, " \t\n", "c"), (7, "one", "c"),
    (8, "one two", "a"), (9, "a" * 900, "b"), (10, "ab" * 300, "b"), (11, "intro\n" + LINES + "\nend here", "c"), (12, "other start\n\n" + LINES + "\nother end", "c"),
    (12, "other start\n\n" + LINES + "\nother end", "c"), (None, "no id here\n" + LINES, "a"), (13, "ünïcödé ☃ " * 60, "d"), (14, "x\n" * 50, None), (15, "ONE", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    # extra columns with the operators' own names
    return df.select("*", *[F.lit(7).alias(c) for c in ("id", "th", "fp", "size", "copies", "kept", "h", "y", "n_lines", "anchor", "shard", "bucket", "digest", "host")])


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def as_set(df):
    return collections.Counter(map(tuple, df.collect()))


def test_simhash(spark, docs, none):
    got = simhash.components(spark, docs).collect()
    fp = [simhash.fingerprint(t) for _, t, _ in ROWS]
    group = list(range(len(ROWS)))
    for _ in ROWS:
        for i in range(len(ROWS)):
            for j in range(len(ROWS)):
                if bin(fp[i] ^ fp[j]).count("1") <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    ids = [min((ROWS[j][0] for j in range(len(ROWS)) if group[j] == g and ROWS[j][0] is not None), default=None) for g in group]
    want = collections.Counter((r[0], f - (1 << 64) if f >> 63 else f, c) for r, f, c in zip(ROWS, fp, ids))
    assert collections.Counter(map(tuple, got)) == want
    assert simhash.components(spark, none).count() == 0
    kept = simhash.keep_first(spark, docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} - {None} == {c for c in ids if c}


def test_simhash_links_are_complete(spark):
    random.seed(3)
    base = [random.getrandbits(64) for _ in range(12)]
    prints = sorted({b ^ sum(1 << k for k in random.sample(range(64), random.randint(0, 4))) for b in base for _ in range(25)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3}
    assert got == want and simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).count() == len(want)


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5, 5)]
    got = dict(map(tuple, connected_components(spark, spark.createDataFrame(edges, "u long, v long")).collect()))
    assert {got[i] for i in range(1, 201)} == {0} and {got[1000 + i] for i in range(1, 100)} == {1000}


def brute_substrings(rows, keep, span=200):
    seen, data = collections.defaultdict(list), [(i, (t or "").encode()) for i, t, _ in rows]
    for k, (_, b) in enumerate(data):
        for p in range(len(b) - span + 1):
            seen[b[p : p + span]].append((k, p))
    cov = [np.zeros(len(b), bool) for _, b in data]
    for v in seen.values():
        for k, p in (v if keep == "none" else v[1:]) if len(v) > 1 else ():
            cov[k][p : p + span] = True
    for (i, b), c in zip(data, cov):
        kept = np.frombuffer(b, np.uint8)[~c].tobytes()
        yield i, len(b), int(c.sum()), int((np.diff(np.append(0, c.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("keep,hot", [("none", 4000), ("none", 1), ("first", 4000), ("first", 1)])
def test_substrings(spark, docs, none, keep, hot):
    rows = ROWS if keep == "none" else [r for r in sorted(set(ROWS), key=lambda r: (r[0] is not None, r[0] or 0))]
    df = docs if keep == "none" else spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = substrings.removed(spark, df, keep=keep, hot_blocks=hot).select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert as_set(got) == collections.Counter(brute_substrings(rows, keep))
    assert substrings.removed(spark, none).count() == 0


@pytest.mark.parametrize("keep", ["none", "first"])
def test_substrings_tells_texts_of_equal_32_bit_hashes_apart(spark, keep):
    """Two texts of one id, or of none, that ``F.hash`` takes for one: what a third document repeats of the first is nothing of the second's."""
    made = spark.range(300_000).select(F.concat(F.sha2(F.col("id").cast("string"), 512), F.sha2((-F.col("id")).cast("string"), 512), F.lit(" end")).alias("t"))
    pair = made.groupBy(F.hash("t").alias("h")).agg(F.sort_array(F.collect_list("t")).alias("ts")).where("size(ts) > 1").orderBy("h").first()
    a, b = pair.ts[:2]
    for same in (None, 7):
        rows = [(same, a, "x"), (same, b, "x"), (9, "as told: " + a, "x")]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = substrings.removed(spark, df, keep=keep).select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert as_set(got) == collections.Counter(brute_substrings(rows, keep)) and got.where(f"id <=> {same or 'NULL'} AND n_removed = 0").count() >= 1


def test_substrings_hot_passage_is_dealt_out(spark):
    """A passage in most documents, with different surroundings, over the share that makes a key hot."""
    passage = " ".join(f"word{i}" for i in range(90))
    rows = [(i, f"start {i * 7919} {passage} end {i}", "x") for i in range(300)] + [(1000 + i, hashlib.sha512(str(i).encode()).hexdigest() * 3, "x") for i in range(50)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = substrings.removed(spark, df).select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert as_set(got) == collections.Counter(brute_substrings(rows, "none"))


def test_previous_factors_against_all_pairs():
    random.seed(4)
    for _ in range(60):
        span = random.choice([8, 16, 20])
        blocks = [bytes(random.choices(b"ab", k=random.randint(1, 60))) for _ in range(random.randint(1, 5))]
        blocks += blocks[:1] * random.randint(0, 1) + [b"a" * 50] * random.randint(0, 1)
        owner, at, lpf, source = substrings.previous_factors(blocks, span)
        places = [(k, p) for k, b in enumerate(blocks) for p in range(len(b))]
        assert list(zip(owner.tolist(), at.tolist())) == places
        for q, (k, p) in enumerate(places):
            earlier = any(blocks[a][b : b + span] == blocks[k][p : p + span] for a, b in places[:q]) and p + span <= len(blocks[k])
            assert (lpf[q] >= span) == earlier
            if earlier:
                a, b = places[source[q]]
                assert source[q] < q and blocks[a][b : b + span] == blocks[k][p : p + span]


def test_substrings_on_the_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    assert as_set(substrings.removed(spark, df).select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == collections.Counter(brute_substrings(list(map(tuple, df.collect())), "none"))


def test_sharding(spark, docs, none):
    got = sharding.assign(docs, sharding.uniform_tree(16)).collect()
    assert collections.Counter((r.id, r.size, r.text_crc32) for r in got) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in ROWS)
    assert sharding.assign(none, sharding.uniform_tree(16)).count() == 0
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    old = {r.id: r for r in sharding.assign(rows, sharding.uniform_tree(16)).collect()}
    new = {r.id: r.shard for r in sharding.assign(rows, sharding.grown(sharding.uniform_tree(16))).collect()}
    assert all(new[i] == r.grown_shard and r.grown_shard in (r.shard, 16) for i, r in old.items())
    sizes = collections.Counter(r.shard for r in old.values())
    assert len(sizes) == 16 and max(sizes.values()) < 350 and min(sizes.values()) > 160
    for s in sizes:
        assert sorted(r.slot for r in old.values() if r.shard == s) == list(range(sizes[s]))


def test_sharding_first_layouts_are_whole_regions():
    assert [len(sharding.uniform_tree(n)) for n in (8, 16, 24)] == [1, 2, 3]
    for n in (0, 7, 17, 23):
        with pytest.raises(ValueError):
            sharding.uniform_tree(n)


def test_sharding_grows_many_times_into_the_new_shard_only(spark):
    rows, tree = spark.range(800).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), sharding.uniform_tree(16)
    for _ in range(7):
        tree = sharding.grown(tree)
    old = {r.id: r.shard for r in sharding.assign(rows, tree).collect()}
    new = {r.id: r.shard for r in sharding.assign(rows, sharding.grown(tree)).collect()}
    moved = {new[i] for i in old if old[i] != new[i]}
    assert moved == {23}


def test_sharding_moves_only_where_weights_change(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    tree = sharding.uniform_tree(16)
    tree[1][1][2] = 3.0
    old = {r.id: r.shard for r in sharding.assign(rows, sharding.uniform_tree(16)).collect()}
    new = {r.id: r.shard for r in sharding.assign(rows, tree).collect()}
    moved = [(old[i], new[i]) for i in old if old[i] != new[i]]
    assert moved and all(b >= 8 for _, b in moved) and not any(a < 8 and b < 8 for a, b in moved)


def weak(c):
    return F.substring(F.sha2(c, 256), 1, 1)


@pytest.mark.parametrize("digest", [exactdedup.sha256, weak])
def test_exact_dedup(spark, docs, none, tmp_path, digest):
    path = str(tmp_path / "docs")
    docs.repartition(3).write.parquet(path)
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    got = exactdedup.groups(spark, path, digest=digest, trigger_files=1).collect()  # several micro-batches
    by = collections.defaultdict(list)
    for i, t, _ in ROWS:
        by[norm(t)].append(i)
    best = {k: max((i for i in v if i is not None), default=None) for k, v in by.items()}
    assert collections.Counter((r.id, r.keep_id, r.group_size) for r in got) == collections.Counter((i, best[norm(t)], len(by[norm(t)])) for i, t, _ in ROWS)
    assert sum(r.kept for r in got) == len(by)
    kept = exactdedup.kept(spark, path, digest=digest)
    assert kept.count() == len(by) and kept.columns == docs.columns
    none.write.parquet(str(tmp_path / "none"))
    assert exactdedup.groups(spark, str(tmp_path / "none")).count() == 0


def test_quality(spark, docs, none):
    got = {r.id: r for r in quality.judged(spark, docs.where("doc_id IS NOT NULL"), host_col="source").collect()}
    assert (got[8].n_words, got[8].base_failed, got[4].n_words, got[4].kept) == (2, True, 0, False)
    assert (got[14].n_dup_lines, got[14].n_repeat_words) == (49, 50) and got[13].n_symbols == 0
    assert quality.judged(spark, none, host_col="source").count() == 0
    bad = [(i, "bad", "short") for i in range(200)] + [(1000 + i, "good", " ".join(f"w{i}x{k}" for k in range(60))) for i in range(200)] + [(5000, "bad", " ".join(f"v{k}" for k in range(60)))]
    rows = {r.id: r for r in quality.judged(spark, spark.createDataFrame(bad, "doc_id long, source string, text string")).collect()}
    assert not rows[5000].kept and not rows[5000].base_failed and all(rows[1000 + i].kept for i in range(200))


@pytest.fixture(scope="module")
def model():
    return pieces.model_bytes(pieces.default_model())


def test_pieces_equal_the_library(spark, docs, none, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    random.seed(5)
    texts = [t or "" for _, t, _ in ROWS] + ["".join(random.choice("aaabc  \n\t☃😀é.,019xyz▁-ありが") for _ in range(random.randint(0, 40))) for _ in range(600)] + [" " * 60, "x" * 2000, "\0a", "<s> <0x0A>"]
    p = pieces.Pieces(model)
    for t, raw in zip(texts, p.encode(texts)):
        ids = np.frombuffer(raw, "<i4").tolist()
        assert ids == sp.encode(t) and p.decode(ids) == sp.decode(ids) == t.replace("▁", " ")
    rows = pieces.encoded(docs, model)
    assert rows.where("NOT round_trip").count() == 0 and rows.count() == len(ROWS) and pieces.encoded(none, model).count() == 0
    back = pieces.decoded(rows, model)
    assert collections.Counter(map(tuple, back.collect())) == collections.Counter((i, t or "") for i, t, _ in ROWS)


def test_toxicity(spark, docs, none):
    random.seed(7)
    words = [f"w{k}" for k in range(300)]
    text = lambda bad: ". ".join(" ".join(random.choices(words, k=8) + (["vilest"] if bad and s == 2 else [])) for s in range(6))
    rows = [(text(k % 5 == 0), int(k % 5 == 0)) for k in range(400)]
    m = toxicity.fit(rows[:300])
    score = toxicity.Scorer(m)
    assert all((score(t)[0] >= 0.7) == bool(y) for t, y in rows[300:])
    s, offending, a, b = score(rows[395][0])
    assert offending == 1 and "vilest" in rows[395][0][a:b] and score("")[0] < 0.1
    out = toxicity.scored(docs, m)
    assert out.count() == len(ROWS) and out.where("score BETWEEN 0 AND 1").count() == len(ROWS) and toxicity.scored(none, m).count() == 0
    assert toxicity.clean(docs, m).columns == docs.columns and toxicity.fit([])["constant"] == 0.0
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert all(y == 1 for _, y in toxicity.sample(docs, labels, "doc_id", "text"))


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    found = toxicity.op7_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert ((found.predicted == 1) == (found.toxic == 1)).mean() > 0.97 and ((found.predicted == 1) & (found.toxic == 0)).mean() < 0.01


def test_budget_fit():
    random.seed(9)
    for _ in range(60):
        lengths = random.sample(range(1, 40), random.randint(1, 5))
        counts = [random.randint(1, 4) for _ in lengths]
        budget = random.randint(0, sum(n * c for n, c in zip(lengths, counts)))
        take = mixing.fit(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts)) and sum(n * t for n, t in zip(lengths, take)) <= budget
        base = [c * budget // max(1, sum(n * c for n, c in zip(lengths, counts))) for c in counts]
        sums = {0}
        for n, c, b in zip(lengths, counts, base):
            sums = {s + n * k for s in sums for k in range(b, c + 1)} if budget < sum(n * c for n, c in zip(lengths, counts)) else sums
        if max(sums):
            assert sum(n * t for n, t in zip(lengths, take)) == max((s for s in sums if s <= budget), default=0)


def test_mixing(spark, docs, none, sf):
    got = mixing.taken(spark, docs).collect()
    size = lambda t: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")])
    assert collections.Counter((r.id, r.size) for r in got) == collections.Counter((i, size(t)) for i, t, _ in ROWS)
    assert all(r.taken in (0, r.size, 2 * r.size) and r.taken <= 2 * r.size for r in got)
    real = mixing.op8_mixing(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id")
    per = real.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("source_size").alias("s")).collect()
    assert sum(r.target for r in per) == pytest.approx(1.5 * sum(r.s for r in per)) and all(r.target - 60 <= r.taken <= r.target + 1e-6 and r.target <= 2 * r.s + 1e-6 for r in per)
    assert as_set(mixing.op8_mixing(spark, sf)) == as_set(mixing.op8_mixing(spark, sf))
    mix = mixing.mixed(spark, docs)
    assert mix.columns == docs.columns and mix.count() == sum(r.copies for r in got)
    assert mixing.taken(spark, none).count() == 0 and mixing.mixed(spark, none).count() == 0


def test_warc(spark):
    page = "<html>" + "hello world " * 20 + "</html>"
    rows = [(5, "http://a/\r\nX: y", page, 1), (3, "http://b", page, 1), (3, "http://b", page, 1), (7, None, None, 1), (8, "u", "", 1), (9, "u", "tiny", 1), (10, "u", "tiny", 1), (None, "u", page, 1), (11, "u", "ü" * 80_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    out = warc.read_archives(spark, warc.write_archives(spark, pages, archive_bytes=50_000)).collect()
    assert collections.Counter((r.page_id, r.record_type, r.refers_to) for r in out) == collections.Counter(
        [("5", "revisit", "3"), ("3", "response", None), ("3", "response", None), ("7", "response", None), ("8", "response", None), ("9", "response", None), ("10", "response", None), (None, "revisit", "3"), ("11", "response", None)]
    )
    for r in out:
        want = next(h or "" for i, _, h, _ in rows if (None if r.page_id is None else int(r.page_id)) == i).encode()
        assert r.payload_bytes == len(want) and r.payload_digest == hashlib.sha256(want).hexdigest() and (r.record_type == "revisit" or r.payload == want)
    assert warc.read_archives(spark, warc.write_archives(spark, pages.where("false"))).count() == 0


def test_warc_reader_rejects_damage():
    rec = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), "response", None)
    data = b"".join(warc.archive([rec] * 20))
    assert [warc.parsed(r)["payload"] for r in warc.frames(io.BytesIO(data))] == [b"payload"] * 20
    for bad in (rec.replace(b"payload", b"PAYLOAD"), rec[:-1], rec.replace(b"WARC/1.1", b"WORC/1.1"), rec.replace(b"WARC-Date: ", b"WARC-Date ")):
        with pytest.raises(ValueError):
            warc.parsed(bad)
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(data[:-5])))


def test_line_dedup(spark, docs, none):
    out = {(r.doc_id, r.text): r for r in linededup.deduplicated(docs).select("doc_id", "text", "n_lines", "n_removed", "n_runs").collect()}
    by = {r.doc_id: r for r in out.values()}
    assert by[None].n_removed == 0 and by[11].n_removed == 6 and by[11].text == "intro\nend here" and by[12].text == "other start\n\nother end"
    assert (by[14].n_lines, by[14].n_removed, by[14].n_runs) == (50, 49, 1) and by[14].text == "x\n" and by[4].text is None
    assert linededup.deduplicated(none).count() == 0


def naive_line_dedup(rows, run=3, words=50):
    """{(id, text): (n_lines, n_removed, n_runs, kept text)} by looking at every window in order."""
    texts = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    seen, out = set(), {}
    for i, t in texts:
        lines = t.split("\n")
        held = [k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for a in range(len(held)):
            for size in range(1, run + 1):
                if a + size <= len(held) and (size == run or sum(len(lines[k].split()) for k in held[a : a + size]) >= words):
                    win = tuple(lines[k] for k in held[a : a + size])
                    if win in seen:
                        gone.update(range(a, a + size))
                    seen.add(win)
                    break
        drop = {held[g] for g in gone}
        out[i, t] = len(held), len(gone), sum(g - 1 not in gone for g in gone), "\n".join(x for k, x in enumerate(lines) if k not in drop)
    return out


def test_line_dedup_against_every_window(spark):
    """A line in a third of all documents, repeated ids, passages of over 50 words in one and two lines, long texts."""
    random.seed(21)
    word = lambda: random.choice("ab") * random.randint(1, 2)
    passage, halves = " ".join(f"p{k}" for k in range(60)), [" ".join(f"q{j}{k}" for k in range(30)) for j in range(2)]
    rows = []
    for i in range(120):
        lines = [" ".join(word() for _ in range(random.randint(0, 2))) for _ in range(random.randint(1, 14))]
        if i % 3 == 0:
            lines.insert(len(lines) // 2, "the common line")
        if i % 10 == 1:
            lines.append(passage)
        if i % 10 == 2:
            lines[:0] = halves
        rows.append((i // 2 if i % 7 else None, "\n".join(lines)))  # ids repeat, with different texts
    rows += [(500, passage), (501, passage), (502, halves[0]), (503, "\n \n".join(halves)), (504, "\n".join(f"l{k % 700}" for k in range(3000))), (505, None), (506, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = naive_line_dedup(rows)
    got = linededup.deduplicated(docs.withColumn("before", F.col("text"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_lines, r.n_removed, r.n_runs, r.text or "") == want[r.doc_id, r.before or ""], r
    assert want[501, passage][1] == 1 and want[503, "\n \n".join(halves)][1] == 2 and want[502, halves[0]][1] == 0


def test_queries_against_their_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLE.items():
        got = queries.QUERIES[name](spark, sf)
        want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
        assert as_set(got) == collections.Counter(want), name


def similar_firsts(rows):
    """Smallest id of each class of texts linked by a Jaccard similarity of 0.8 or more of their sets of five words, all pairs compared."""
    sets = {}
    for i, t in rows:
        words = [w.lower() for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    root = {i: i for i in sets}
    linked = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4]
    for _ in range(8):
        for i, j in linked:
            root[i] = root[j] = min(root[i], root[j])
    return sorted(set(root.values()))


def test_pipeline_against_brute_force(spark, sf):
    """Each stage against plain code over what the stage before kept."""
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = toxicity.trained(spark, sf)
    for name, stage in pipe.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        stage(spark, docs, sf).write.mode("overwrite").parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns
        ids = collections.Counter(r.doc_id for r in after.collect())
        if name == "toxicity":
            want = collections.Counter(i for i, t in before if toxicity.Scorer(m)(t)[0] < 0.7)
        elif name == "exact_dedup":
            best = {}
            for i, t in before:
                k = t.encode().lower()
                best[k] = max(best.get(k, i), i)
            want = collections.Counter(best.values())
        elif name == "near_dedup":
            want = collections.Counter(similar_firsts(before))
        else:
            copies = {r.id: r.copies for r in mixing.taken(spark, docs).collect()}
            want = collections.Counter({i: c for i, c in copies.items() if c})
        assert ids == want, name
        docs = after
    out = pipe.STAGES[-1][1](spark, docs, sf)
    assert out.count() == docs.count() and out.where("NOT round_trip").count() == 0


def test_near_stage_finds_every_similar_text(spark, sf):
    """Edited copies at a Jaccard similarity of 0.8 or more go, though most differ by more than three fingerprint bits; others stay."""
    import corpus_pipeline as pipe

    from touchline.llm import neardup

    random.seed(11)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    rows = []
    for base in range(6):
        text = [word() for _ in range(250)]
        for edit in range(12):
            new = list(text)
            for k in random.sample(range(250), edit):
                new[k] = word()
            rows.append((100 * base + edit, " ".join(new)))
    sets = {i: set(neardup.shingles(t).tolist()) for i, t in rows}
    root = {i: i for i in sets}
    linked = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4]
    for _ in range(8):
        for i, j in linked:
            root[i] = root[j] = min(root[i], root[j])
    fp = {i: simhash.fingerprint(t) for i, t in rows}
    assert any(bin(fp[i] ^ fp[j]).count("1") > 3 for i, j in linked) and len(set(root.values())) < len(rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, s string").repartition(3)
    kept = pipe.near_stage(spark, docs, sf)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))
    assert pipe.near_stage(spark, docs.where("false"), sf).count() == 0


def test_rows_without_an_id_or_with_a_repeated_one_are_decided_alone(spark):
    rows = [(1, PROSE), (None, PROSE), (None, "alone " * 40), (None, "pair of rows " * 30), (None, "pair of rows " * 30), (7, "first text " * 30), (7, PROSE.upper()), (None, None), (8, "twice " * 9), (8, "twice " * 9)]
    kept = simhash.keep_first(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(1, PROSE), (None, "alone " * 40), (None, "pair of rows " * 30), (7, "first text " * 30), (None, None), (8, "twice " * 9)]
    assert as_set(kept) == collections.Counter(want)
