"""Each operator against a brute-force version: driver rows, and a fixture of odd rows (nulls, blanks, repeats, clashing columns, no rows)."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenweft.llm import best_fit_packing, cws_fingerprint, exact_topk, language_id, license_scan, minhash_dedup, oracles, queries, source_mix, substring_dedup, token_stream, toxicity_fm
from lumenweft.llm._shared import Scratch, read_table
from tests.llm import brute

DIR = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tag_a string, node string, size string, row string"


def odd_rows():
    r = random.Random(5)
    base = [r.choice(WORDS) for _ in range(120)]
    near = base[:60] + ["other"] + base[61:]
    texts = [None, "", " \t\n", "one", "one two", " ".join(base), " ".join(near), " ".join(base), " ".join(r.choices(WORDS, k=90) + base[10:60]), "same " * 80, "same " * 80 + "end", "ÉÀ ß 中文 \U0001f600 x" * 9, " a b c", " ".join(r.choices(WORDS, k=30_000))]
    texts += ["Licensed under CC BY-NC 4.0. cc by CC by\nAll Rights\nreserved", "This work is licensed under the GNU General Public License, version 3."]
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t), "x", "y", "z", "q") for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, " ".join(base[:100]), None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def driver_rows():
    return [tuple(r) for r in duckdb.sql(f"select doc_id, text from '{DIR}/documents.parquet' order by doc_id").fetchall()]


def bag(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def test_substring_dedup(spark, odd, none, driver_rows):
    cols = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert bag(queries.op2_substring_dedup(spark, DIR).select(*cols).collect()) == bag(brute.substring(driver_rows))
    for width in (35, 3):
        got = substring_dedup.repeated_passages(odd, Scratch(spark, "t"), width).select(*cols).collect()
        assert bag(got) == bag(brute.substring(pairs(odd_rows()), width))
    assert substring_dedup.repeated_passages(none, Scratch(spark, "t")).count() == 0


def test_removing_repeats_keeps_columns_and_clean_texts(spark, odd):
    out = substring_dedup.remove_repeats(odd, Scratch(spark, "t"), 35)
    assert out.columns == odd.columns and out.count() == len(odd_rows())
    want = {(k, d) for k, _, _, d in brute.substring(pairs(odd_rows()))}
    for r in out.collect():
        assert (r.doc_id, hashlib.sha256(" ".join(brute.WORD.findall(r.text or "")).encode()).hexdigest()) in want
    assert {r.text for r in out.filter("doc_id = 11").collect()} == {odd_rows()[11][1]}


@pytest.mark.parametrize("seed", range(6))
def test_windows_have_anchors_of_their_own_words(seed):
    """The anchor of a window doesn't depend on what stands around it."""
    r = np.random.default_rng(seed)
    core = r.integers(1, 4 + 40 * (seed % 3), 60).astype(np.uint64)
    seen = []
    for _ in range(20):
        words = np.concatenate([r.integers(1, 9, r.integers(0, 50)), core, r.integers(1, 9, r.integers(0, 50))]).astype(np.uint64)
        at, anchor, sure = substring_dedup.window_anchors(words, np.zeros(len(words), np.int64), 35)
        where = {words[i : i + 35].tobytes(): (a, s) for i, a, s in zip(at, anchor, sure)}
        seen.append([where[core[i : i + 35].tobytes()] for i in range(26)])
    assert all(x == seen[0] for x in seen)


def test_near_duplicates(spark, odd, none, driver_rows):
    cols = ["doc_id", "n_shingles", "component_id"]
    assert bag(queries.op7_minhash_dedup(spark, DIR).select(*cols).collect()) == bag(brute.components(driver_rows))
    for width in (2, 5):
        got = minhash_dedup.near_duplicates(odd, Scratch(spark, "t"), width)
        assert bag(got.select(*cols).collect()) == bag(brute.components(pairs(odd_rows()), width))
        assert got.filter("is_first").count() == got.select(F.coalesce("component_id", F.lit(-1)), F.when(F.col("n_shingles") == 0, F.col("node"))).distinct().count()
    assert minhash_dedup.near_duplicates(none, Scratch(spark, "t")).count() == 0
    kept = minhash_dedup.keep_first(odd, Scratch(spark, "t"))
    assert kept.columns == odd.columns and {3, 4, 11} <= {r.doc_id for r in kept.collect()}


def test_large_groups_of_edited_copies(spark):
    r = random.Random(3)
    base, rows = [r.choice(WORDS) for _ in range(150)], []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash_dedup.near_duplicates(df, Scratch(spark, "t"), 2).select("doc_id", "n_shingles", "component_id").collect()
    assert bag(got) == bag(brute.components(rows))


def test_families_without_links_make_no_pairs(spark):
    """Texts that share 87 % and aren't copies: what the join across components holds against each other doesn't grow with their square."""
    r, met = random.Random(8), {}
    base = [r.choice(WORDS) + str(i) for i in range(260)]
    for n in (100, 200):
        rows = [(i, " ".join(base + [f"own{i}x{j}" for j in range(39)])) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert bag(minhash_dedup.near_duplicates(docs, Scratch(spark, "t"), 2).select("doc_id", "n_shingles", "component_id").collect()) == bag(brute.components(rows))
        scratch = Scratch(spark, "t")
        held = scratch.table(docs.select(F.col("doc_id").alias("node"), "text"), "held")
        members = scratch.table(held.select("node", F.lit(298).alias("n_shingles")), "members")
        prefix = minhash_dedup._whole_prefixes(held, members, scratch, 2, 80)
        lists = minhash_dedup._open_lists(prefix, spark.createDataFrame([], "node long, root long"), scratch, "open")
        assert lists.groupBy("v").count().agg({"count": "max"}).first()[0] == n
        small, large = minhash_dedup._roles(lists, 80)
        met[n] = small.select("v", "node").join(large.select("v"), "v").count()
    assert met[200] <= 2 * met[100]


def test_pairs_across_components_near_the_threshold(spark):
    """Families around the threshold, where some pairs are links and the texts' sizes differ."""
    r, rows = random.Random(9), []
    base = [r.choice(WORDS) + str(i) for i in range(90)]
    for i in range(120):
        w = list(base[: r.randint(74, 90)])
        for _ in range(r.randint(2, 7)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = minhash_dedup.near_duplicates(df, Scratch(spark, "t"), 2).select("doc_id", "n_shingles", "component_id").collect()
    assert bag(got) == bag(brute.components(rows)) and len({x.component_id for x in got}) > 3


def test_licenses(spark, odd, none, driver_rows):
    want = brute.licenses(driver_rows, license_scan.TEMPLATES, license_scan.PHRASES, license_scan.THRESHOLD)
    assert bag(queries.op3_license_scan(spark, DIR).collect()) == bag(want)
    got = license_scan.scan_licenses(odd, Scratch(spark, "t")).collect()
    assert bag(got) == bag(brute.licenses(pairs(odd_rows()), license_scan.TEMPLATES, license_scan.PHRASES, license_scan.THRESHOLD))
    assert license_scan.scan_licenses(none, Scratch(spark, "t")).count() == 0


def test_notices_over_several_lines(spark):
    """Headers as they stand in files are found, words far from each other aren't, whatever the lines."""
    def wrapped(text, mark, width=9):
        w = text.split()
        return "\n".join(mark + " ".join(w[i : i + width]) for i in range(0, len(w), width))

    r, t = random.Random(1), license_scan.TEMPLATES
    filler = lambda n: " ".join(r.choices(WORDS, k=n))
    far = " ".join(f"{x} {filler(40)}" for x in t["notice-cc-by"].split())
    rows = [(0, f"{filler(33)}\n{wrapped(t['text-mit'], ' * ')}\n{filler(500)}"), (1, wrapped(t["text-gpl-3"], "# ", 4)), (2, f"{filler(7)}\n" + wrapped(t["text-apache-2"], "// ")), (3, far), (4, "Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and associated\n# documentation files"), (5, "license " * 5000)]
    got = {x.doc_id: x for x in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()}
    assert "text-mit" in got[0].labels and "notice-mit-grant" in got[0].labels and "text-gpl-3" in got[1].labels and "text-apache-2" in got[2].labels and "notice-mit-grant" in got[4].labels
    assert got[3].labels == "" and got[3].score == 0 and got[5].labels == ""
    assert bag(got.values()) == bag(brute.licenses(rows, t, license_scan.PHRASES, license_scan.THRESHOLD))


@pytest.mark.parametrize("name", sorted(oracles.oracles()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DIR), con.sql(oracles.oracles()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert bag(got.select(*columns).collect()) == bag([tuple(r[i] for i in at) for r in want.fetchall()])


def test_top_k_with_ties_and_bad_vectors(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 4)]) for i in range(300)] + [(7, [1.0, 1.0, 1.0, 1.0]), (301, None), (302, [float("nan")] * 4), (303, [None, 1.0, 1.0, 1.0]), (None, [1.0] * 4), (304, [1.0, 2.0]), (305, [1e9, -1e9, 3.0, 4.0])]
    x = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).select("vec_id", exact_topk.whole_numbers("embedding").alias("v"))
    got = exact_topk.top_k(x, x.filter("vec_id % 50 = 0"), Scratch(spark, "t"), 5, shard_rows=70)
    good = [(i, [int(np.floor(256 * y)) for y in v]) for i, v in rows if i is not None and v is not None and not any(y is None or not np.isfinite(y) for y in v)]
    want = []
    for q, v in good:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, u)), i) for i, u in good if i != q and len(u) == len(v))[:5]
            want += [(q, k + 1, i, -n) for k, (n, i) in enumerate(s)]
    assert bag(got.collect()) == bag(want)
    assert exact_topk.top_k(x.limit(0), x.limit(0), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize(("dims", "most"), [(2, 0.2), (4, 0.5), (48, 1.0)])
def test_boxes_prune_in_few_dimensions(dims, most):
    """Scores and ties by brute force, and the share of rows that a query is held against."""
    g = np.random.default_rng(dims)
    vectors = g.integers(-300, 300, (6000, dims))
    ids, queries = g.permutation(6000), np.arange(100)
    tree = exact_topk.Tree(ids, vectors.astype(np.float64), 64)
    scores, found = np.zeros((100, 5)), np.full((100, 5), exact_topk.NONE)
    asked = np.array([vectors[np.flatnonzero(ids == i)[0]] for i in queries], np.float64)
    tree.search(asked, queries, scores, found)
    for i, q in enumerate(asked):
        s = vectors @ q.astype(int)
        want = [(j, x) for x, j in sorted((-x, j) for x, j in zip(s.tolist(), ids.tolist()) if j != queries[i])[:5] for x in (-x,)]
        assert list(zip(found[i].tolist(), scores[i].tolist())) == want
    assert tree.read <= most * 100 * 6000


def test_mix(spark, odd, none):
    plan = source_mix.mix_plan(odd, Scratch(spark, "t")).toPandas()
    sizes = {}
    for r in odd_rows():
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.WORD.findall(r[1] or ""))
    want = brute.water_levels(sizes)
    for source, part in plan.groupby(plan["source"].where(plan["source"].notna(), None), dropna=False):
        key = None if source is None or source != source else source
        assert np.allclose(part.target, want[key]) and (part.source_size == sizes[key]).all()
        assert abs(part.taken.sum() - want[key]) <= part["size"].max()
    assert (plan.taken <= 3 * plan["size"]).all() and len(plan) == len(odd_rows())
    again = source_mix.mix_plan(odd.repartition(2), Scratch(spark, "t")).toPandas()
    assert bag(plan[["doc_id", "size", "taken"]].values) == bag(again[["doc_id", "size", "taken"]].values)
    assert source_mix.mix_plan(none, Scratch(spark, "t")).count() == 0
    stream = source_mix.mixed_stream(odd, Scratch(spark, "t"))
    assert stream.columns == odd.columns and stream.count() == plan.copies.sum()


def test_mix_of_rows_that_sources_share(spark):
    """Equal rows in several sources, and within one: each source's copies are those of its plan."""
    rows = [(i % 60, f"{'word ' * (1 + i % 7)}{i % 60}", f"s{i // 90}") for i in range(270)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    plan = source_mix.mix_plan(docs, Scratch(spark, "t")).groupBy("source").agg(F.sum("copies").alias("n"))
    got = source_mix.mixed_stream(docs, Scratch(spark, "t")).groupBy("source").agg(F.count("*").alias("n"))
    assert bag(got.collect()) == bag(plan.collect())


def test_positions_invert_the_schedules(spark):
    """Positions against each schedule's integral, summed in small steps, and the order of the stream against them."""
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 30)), f"s{i % 3}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plan = source_mix.mix_plan(docs, Scratch(spark, "t")).collect()
    t = np.linspace(0, 1, 200_001)
    for turn, source in enumerate(["s0", "s1", "s2"]):
        a, b = source_mix.RAMPS[turn]
        w = a + (b - a) * t
        met = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2) * (t[1] - t[0])])
        mine = sorted((r for r in plan if r.source == source), key=lambda r: hashlib.md5(f"{r.doc_id}:{rows[r.doc_id][1]}".encode()).hexdigest())
        at = 0
        for r in mine:
            share = [(j * r.source_size + at + r.size / 2) / r.target for j in range(3)]
            assert np.allclose(r.positions, np.interp([x for x in share if x <= 1], met, t), atol=1e-5)
            at += r.size
    want = [r.doc_id for _, r in sorted((p, r) for r in plan for p in r.positions)]
    assert [r.doc_id for r in source_mix.mixed_stream(docs, Scratch(spark, "t")).collect()] == want


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def held_to_whole_texts(got, rows):
    """Per document, in stream order: ascending ids (equal ones in any order), starts without gaps, ids of the whole text."""
    tok, at = token_stream.encoder(queries.byte_bpe_path()).tokenizer, 0
    got = got.orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda k: (k is not None, k or 0))
    assert bag((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == bag((k, len(ids), brute.crc(ids)) for k, ids in ((k, ids_of(tok, t)) for k, t in rows))
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_token_files_round_trip(spark, odd, none, driver_rows):
    path = queries.byte_bpe_path()
    held_to_whole_texts(token_stream.token_files(odd, Scratch(spark, "t"), path, length=64), pairs(odd_rows()))
    held_to_whole_texts(queries.op1_token_files(spark, DIR), driver_rows)
    assert token_stream.token_files(none, Scratch(spark, "t"), path).count() == 0


def test_one_id_over_many_shards(spark):
    """An id that holds all rows is spread, and its shards follow each other."""
    rows = [(7, f"text {i} " * (i % 9)) for i in range(400)]
    scratch, path = Scratch(spark, "t"), queries.byte_bpe_path()
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    manifest = scratch.table(token_stream.write_token_files(docs, f"{scratch.path}/tokens", path, 32, shards=4), "manifest")
    assert manifest.count() > 1 and manifest.agg({"documents": "sum"}).first()[0] == 400
    got = token_stream.read_token_files(manifest, f"{scratch.path}/tokens", "int")
    assert dict(got.dtypes)["doc_id"] == "int"
    held_to_whole_texts(got, rows)


def test_long_shard_is_read_in_full(tmp_path):
    """More tokens than one batch holds, with sequences that end inside batches."""
    w = token_stream.ShardWriter(pa.fs.LocalFileSystem(), str(tmp_path / "a.arrow"), 16, np.dtype("<u2"))
    parts = [np.arange(n, dtype="<u2") for n in (5, 10_000, 1, 4095, 9)]
    for p in parts:
        w.add(p)
    w.close(pa.table({"doc_id": [1]}))
    whole, r = np.concatenate(parts), token_stream.ShardReader(pa.fs.LocalFileSystem(), str(tmp_path / "a.arrow"))
    for start, n in ((0, 5), (4090, 12), (0, len(whole)), (len(whole) - 3, 3)):
        assert (r.tokens(start, n) == whole[start : start + n]).all()
    count = sum(r.file.get_batch(i).num_rows for i in range(r.file.num_record_batches))
    masks = np.concatenate([r.mask(i) for i in range(count)])
    assert masks.sum() == len(whole) and masks[: len(whole)].all() and len(masks) == 16 * count
    padded = np.concatenate([r.sequence(i) for i in range(count)])
    assert (padded[: len(whole)] == whole).all() and not padded[len(whole) :].any()
    assert not r.sequence(3).flags.owndata and not r.tokens(0, 5).flags.owndata  # views of the mapped file
    with pytest.raises(ValueError):
        r.tokens(16 * count, 1)


def test_pieces_give_the_ids_of_whole_texts():
    enc, r = token_stream.encoder(queries.byte_bpe_path()), random.Random(2)
    signs = [*"ab1. \n\t  '!,é\u0085\x1c\x00中\U0001f600s", "<|endoftext|>", "'s", "'ll", "\r\n", "​", "́", "ǅ", " the", ".\nThe"]
    texts = ["".join(r.choices(signs, k=r.randint(0, 40))) for _ in range(5000)]
    assert all(enc.tokenizer.encode(t, add_special_tokens=False).ids == np.frombuffer(x, enc.dtype).tolist() for t, x in zip(texts, enc.encode(texts)))


def test_packing(spark, odd, none):
    tok = token_stream.encoder(queries.byte_bpe_path()).tokenizer
    got = best_fit_packing.pack_documents(odd, Scratch(spark, "t"), queries.byte_bpe_path(), 256).toPandas()
    want = []
    for key, text in pairs(odd_rows()):
        ids = ids_of(tok, text)
        want += [(key, k, s, n, brute.crc(ids[s : s + n])) for k, (s, n) in enumerate(best_fit_packing.cut_points(len(ids), 256))]
    assert bag([(None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]) == bag(want)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()][:-1] and s.length.sum() <= 256
    assert best_fit_packing.pack_documents(none, Scratch(spark, "t"), queries.byte_bpe_path()).count() == 0
    assert best_fit_packing.cut_points(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]


def test_packing_nears_the_least_number_of_sequences(spark):
    got = queries.op8_best_fit_packing(spark, "/root/testdata/sf0.01").select("length", "sequence_id").toPandas()
    assert got.sequence_id.nunique() <= 1.005 * -(-got.length.sum() // 2048)


def test_best_fit_closes_the_fullest():
    b = best_fit_packing.BestFit(10, 2)
    assert [b.place(n) for n in (6, 7, 4, 3)] == [(0, 0), (1, 0), (0, 6), (1, 7)]
    b = best_fit_packing.BestFit(10, 2)
    assert [b.place(n) for n in (6, 7, 8, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6)]


def test_language(spark, odd, none):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang").toPandas()
    got = queries.op5_language_id(spark, "/root/testdata/sf0.01").toPandas().merge(docs)
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.97 and got.score.between(0, 1).all()
    model = language_id.fit(odd)
    pred = {r.doc_id: r.lang_pred for r in language_id.identify(odd.select("doc_id", "text"), model).collect()}
    assert pred[0] == pred[1] == pred[2] == "und" and pred[4] == "en"
    assert {r.lang_pred for r in language_id.identify(odd.select("text"), language_id.fit(none)).collect()} == {"und"}


def test_toxicity(spark, none):
    labels = read_table(spark, "/root/testdata/sf0.01", "labels").toPandas()
    got = queries.op9_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    both = got.merge(labels)
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (both.predicted == both.toxic).mean() > 0.93 and both[both.toxic == 0].predicted.mean() < 0.01
    model = toxicity_fm.fit(none.select("doc_id", "text", F.lit(1).alias("label")))
    assert toxicity_fm.score(none.select("text"), model).count() == 0


def test_pairs_of_terms_are_learned():
    """Neither term is toxic alone, both together are."""
    a, b, rest, r = 3, 5, range(10, 60), np.random.default_rng(0)
    rows = []
    for i in range(3000):
        pick = [x for x, on in ((a, i % 4 in (1, 3)), (b, i % 4 in (2, 3))) if on]
        rows.append((np.unique(np.array([*pick, *r.choice(rest, 4)])), int(i % 4 == 3)))
    model = toxicity_fm.train(rows, bits=6, epochs=30)
    got = model.scores(np.array([a, b, a, b]), np.array([0, 1, 2, 4, 4]))
    assert got[0] < 0.5 and got[1] < 0.5 and got[2] > 0.5 and got[3] < 0.5


def test_pairs_of_weakly_associated_terms_are_learned():
    """Each term stands in 5 % of the rows and is weakly associated by itself; 11 % are toxic for other reasons."""
    g, rows = np.random.default_rng(0), []
    for _ in range(8000):
        a, b, other = g.random(3) < (0.05, 0.05, 0.11)
        rows.append((np.unique(np.array([*[3][: int(a)], *[5][: int(b)], *g.integers(10, 500, 20)])), int(bool(other or (a and b)))))
    model = toxicity_fm.train(rows, bits=9)
    got = model.scores(np.array([3, 5, 3, 5, 20, 30]), np.array([0, 1, 2, 4, 6]))
    assert got[0] < 0.5 and got[1] < 0.5 and got[2] > 0.5 and got[3] < 0.5


def test_terms_that_are_toxic_only_apart():
    """Exclusive or: the shares of either term by itself say nothing, and no weights without factors can tell."""
    g, rows = np.random.default_rng(1), []
    for _ in range(4000):
        a, b = g.random(2) < 0.5
        rows.append((np.unique(np.array([*[3][: int(a)], *[5][: int(b)], *g.integers(10, 500, 20)])), int(a != b)))
    model = toxicity_fm.train(rows, bits=9)
    got = model.scores(np.array([3, 5, 3, 5]), np.array([0, 0, 1, 2, 4]))
    assert (got >= 0.5).tolist() == [False, True, True, False]
    flat, bounds = np.concatenate([t for t, _ in rows]), np.concatenate([[0], np.cumsum([len(t) for t, _ in rows])])
    y = np.array([y for _, y in rows])
    plain = toxicity_fm.Model(model.bias, model.weights, np.zeros_like(model.factors), model.bits)
    assert ((model.scores(flat, bounds) >= 0.5) == y).mean() > 0.99 and ((plain.scores(flat, bounds) >= 0.5) == y).mean() < 0.8
    assert np.flatnonzero(model.weights).tolist() == [3, 5]


def test_scores_are_sums_over_terms_and_pairs(spark, odd):
    """The machine's formula, pair by pair, over words found apart from the kernel."""
    g = np.random.default_rng(2)
    model = toxicity_fm.Model(-1.0, g.normal(0, 0.3, 1 << 12).astype(np.float32), g.normal(0, 0.2, (1 << 12, 3)).astype(np.float32), 12)
    rows = [r for r in odd_rows() if r[1] is None or len(r[1]) < 2000]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("toxicity", F.lit("mine"))
    scored = toxicity_fm.score(docs, model)
    assert scored.columns == docs.columns
    for r in scored.collect():
        words = sorted(set(brute.ALNUM.findall((r.text or "").lower())))
        terms = sorted({int(toxicity_fm.hashed_terms(pa.array([w]), 12)[0][0]) for w in words})
        z = model.bias + sum(float(model.weights[i]) for i in terms)
        z += sum(float(model.factors[i] @ model.factors[j]) for n, i in enumerate(terms) for j in terms[:n])
        assert abs(r.toxicity - 1 / (1 + np.exp(-z))) < 1e-4


def test_toxicity_of_odd_rows(spark, odd, none):
    """Nulls, blanks, long texts and repeats are scored; repeated ids bring one text each to the driver."""
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(16)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    for docs in (odd, odd.union(odd).union(odd)):
        model = toxicity_fm.fit_on_labels(spark, docs, labels)
        got = toxicity_fm.score(docs, model).collect()
        assert len(got) == docs.count() and all(0 <= r.toxicity <= 1 for r in got)
    assert toxicity_fm.score(none, toxicity_fm.fit_on_labels(spark, none, labels)).count() == 0


def test_language_by_dictionaries(spark, odd):
    """Naive Bayes with a dictionary of n-grams per language, over the same rows; every language is learned, however rare."""
    import re

    rows = [(i, t, lang, None, None, None, None, None, None) for i, (t, lang) in enumerate([(f"the cat {i} and the dog", "en") for i in range(60)] + [(f"der Hund {i} und die Katze", "de") for i in range(40)] + [("kissa ja koira", "fi"), (None, "en"), ("the", None), ("  1 2 !", "en")])]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("mine"))
    model = language_id.fit(docs)

    def grams(text):
        t = re.sub(r"[^a-z]+", " ", text.lower() + " ")
        return [t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1) if n > 1 or t[i] != " "]

    bucket = lambda x: sum((ord(c) * 0x110000 ** (len(x) - 1 - i)) for i, c in enumerate(x)) % 2**64 * (0x9E3779B97F4A7C15 + 2 * len(x)) % 2**64 >> 50
    counts, docs_of = {}, {}
    for _, t, lang, *_ in rows:
        if t is not None and lang is not None:
            docs_of[lang] = docs_of.get(lang, 0) + 1
            for x in grams(t):
                counts.setdefault(lang, {}).setdefault(bucket(x), 0)
                counts[lang][bucket(x)] += 1
    langs = sorted(counts)
    got = language_id.identify(docs, model)
    assert got.columns == [*[c for c in docs.columns if c != "score"], "lang_pred", "score"] and model.langs == langs == ["de", "en", "fi"]
    for r in got.collect():
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        mine = [bucket(x) for x in grams(r.text)]
        logit = [(np.log(docs_of[x] / sum(docs_of.values())) + sum(np.log((counts[x].get(b, 0) + 0.5) / (sum(counts[x].values()) + 0.5 * 2**14)) for b in mine)) / len(mine) ** 0.5 for x in langs]
        post = np.exp(logit - max(logit)) / np.exp(logit - max(logit)).sum()
        assert r.lang_pred == langs[int(post.argmax())] and abs(r.score - post.max()) < 1e-6
    assert {r.doc_id: r.lang_pred for r in got.collect()}[100] == "fi"


def test_fingerprints(spark, odd, none):
    got = cws_fingerprint.compare_with_next(odd, Scratch(spark, "t")).toPandas()
    assert len(got) == len(odd_rows()) and got.near_edited.between(0, 1).all()
    assert got.groupby("fingerprint").size().max() >= 3  # repeated rows
    rows = [(i, f"text {i} of some words") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for r in cws_fingerprint.compare_with_next(df, Scratch(spark, "t")).collect():
        want = cws_fingerprint.edited(rows[r.doc_id][1], rows[(r.doc_id + 1) % 40][1])
        assert r.edited_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.n_chars == len(rows[r.doc_id][1])
    assert cws_fingerprint.compare_with_next(none, Scratch(spark, "t")).count() == 0
    named = odd.withColumn("fingerprint", F.lit("mine"))
    assert cws_fingerprint.fingerprint(named).columns == named.columns


def test_fingerprints_by_one_term_at_a_time(spark, driver_rows):
    """The registered query against samples drawn term by term, in plain numbers, and texts edited apart from the operator."""
    rows = sorted(driver_rows)[:12]
    m, mask = cws_fingerprint.SAMPLES, 2**64 - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    def samples(text):
        terms, count, _ = cws_fingerprint.weighted_terms(pa.array([text]))
        best = [(np.inf, None)] * m
        for term, n in zip(terms.tolist(), count.tolist()):
            v = np.array([mix((term + k * 0xD1342543DE82EF95) & mask) for k in range(1, 2 * m + 1)], np.uint64).view(np.uint32)
            u = ((v >> np.uint32(8)) | np.uint32(1)).astype(np.float64) / 2**24
            b = ((v[:m] << np.uint32(16)) ^ (v[m : 2 * m] << np.uint32(8)) ^ v[2 * m : 3 * m]) & np.uint32(0xFFFFFF)
            r, c, b = -np.log(u[:m] * u[m : 2 * m]), -np.log(u[2 * m : 3 * m] * u[3 * m :]), b / 2**24
            t = np.floor(np.log(n) / r + b)
            a = np.log(c) - r * (t - b) - r
            best = [min(x, (y, (term, int(z))), key=lambda q: q[0]) for x, y, z in zip(best, a, t)]
        return [x for _, x in best]

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in cws_fingerprint.compare_with_next(docs, Scratch(spark, "t")).collect()}
    assert {r.doc_id for r in queries.op10_cws_fingerprint(spark, DIR).collect()} == {k for k, _ in driver_rows}
    of = {k: samples(t) for k, t in rows}
    for n, (key, text) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        half = len(text) // 2
        changed = samples(text[: len(text) - half] + following[:half])
        gap = 2 / m  # 32-bit logarithms may turn a near tie
        assert abs(got[key].near_edited - np.mean([x == y for x, y in zip(of[key], changed)])) <= gap
        assert abs(got[key].near_next - np.mean([x == y for x, y in zip(of[key], of[rows[(n + 1) % len(rows)][0]])])) <= gap


def test_likeness_estimates_generalised_jaccard():
    r, gaps = random.Random(4), []
    for _ in range(20):
        a = r.choices(WORDS, k=200)
        b = a[: r.randint(50, 199)] + r.choices(WORDS, k=40)
        x, y = ({}, {})
        for w, c in ((a, x), (b, y)):
            for p in zip(w, w[1:]):
                c[p] = c.get(p, 0) + 1
        true = sum(min(x.get(k, 0), y.get(k, 0)) for k in x) / sum(max(x.get(k, 0), y.get(k, 0)) for k in x | y)
        s = cws_fingerprint.signatures(pa.array([" ".join(a), " ".join(b)]))
        gaps.append(cws_fingerprint.likeness(s[:1], s[1:])[0] - true)
    assert abs(np.mean(gaps)) < 0.05 and np.abs(gaps).max() < 0.25


@pytest.mark.parametrize("n", [20_000, 100_000])
def test_long_unrelated_texts_are_unlike(n):
    """However many terms a text has, only shared ones make it like another."""
    g = np.random.default_rng(n)
    words = [[f"{x}" for x in g.permutation(10**6)[:n]] for _ in range(2)]
    half = words[0][: n // 2] + words[1][n // 2 :]
    s = cws_fingerprint.signatures(pa.array([" ".join(w) for w in (*words, half)]))
    assert cws_fingerprint.likeness(s[:1], s[1:2])[0] < 0.03
    assert abs(cws_fingerprint.likeness(s[:1], s[2:])[0] - 1 / 3) < 0.2 and abs(cws_fingerprint.likeness(s[1:2], s[2:])[0] - 1 / 3) < 0.2
