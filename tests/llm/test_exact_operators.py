"""Operators with one right answer, against brute force on awkward corpora."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import fixtures as fx
from chromaweave.llm import decontamination
from chromaweave.llm.components import connected_components
from chromaweave.llm.decontamination import decontaminate, keep_uncontaminated
from chromaweave.llm.jaccard_join import jaccard_components, keep_first_of_component
from chromaweave.llm.licences import KNOWN, scan_licences
from chromaweave.llm.substring_dedup import SuffixAutomaton, remove_repeated_words
from chromaweave.llm.suffix_dedup import cut_repeated_bytes, remove_repeated_bytes, suffix_array
from chromaweave.llm.token_counts import token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")


def rows_of(df, *names):
    return sorted(map(repr, (tuple(r) for r in df.select(*names).collect())))


def same(got, want):
    assert got == sorted(map(repr, want))


@pytest.mark.parametrize("seed", [0, 1])
def test_token_counts(spark, seed):
    from tokenizers import Tokenizer

    rows = fx.corpus(seed) + [(900, "é  　 \u0085 ²③ 𝟛 ǅ ​  'S's don't"), (901, "a" * 5000), (902, "z " * 1025)]
    lengths = [len(e) for e in Tokenizer.from_file(BPE).encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    for memory in (1_500_000, 200):
        got = token_counts(fx.table(spark, rows), BPE, postings_in_memory=memory)
        same(rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit"), [(i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(rows, lengths)])


@pytest.mark.parametrize(("seed", "hot"), [(0, 500), (1, 500), (2, 500), (0, 1), (1, 2), (4, 1)])
def test_repeated_bytes(spark, seed, hot):
    rows = fx.corpus(seed)
    got = remove_repeated_bytes(fx.table(spark, rows).repartition(3), length=50, hot=hot)
    same(rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), fx.repeated_bytes(rows, 50))


def test_cut_texts_keep_their_columns(spark):
    rows = fx.corpus(3)
    docs = fx.table(spark, rows)
    got = cut_repeated_bytes(docs, length=50)
    assert got.columns == docs.columns and got.count() == docs.count()
    same(rows_of(got, "doc_id", "order_id", "text_key", "row", "spans", "n", "label"), [tuple(r) for r in docs.select("doc_id", "order_id", "text_key", "row", "spans", "n", "label").collect()])
    whole = {r.doc_id: r.n_removed for r in remove_repeated_bytes(docs, length=50).collect()}
    for r in got.where("doc_id IS NOT NULL").collect():
        assert r.n_chars == (None if r.text is None else len(r.text)) or r.text is None
        if not whole[r.doc_id]:
            assert (r.doc_id, r.text) in rows


@pytest.mark.parametrize(("seed", "hot"), [(0, 500), (1, 500), (2, 500), (0, 1), (1, 2), (4, 1)])
def test_repeated_words(spark, seed, hot):
    rows = fx.corpus(seed)
    got = remove_repeated_words(fx.table(spark, rows).repartition(3), length=20, hot=hot)
    same(rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256"), fx.repeated_words(rows, 20))


def test_suffix_array_is_sorted():
    import numpy as np

    rng = np.random.default_rng(0)
    for size in (1, 2, 7, 300):
        for symbols in (1, 2, 5):
            text = rng.integers(0, symbols, size).astype(np.uint8)
            order = suffix_array(text, size + 8)
            assert order.tolist() == sorted(range(size), key=lambda k: bytes(text[k:]))


def test_matching_statistics():
    import random

    rng = random.Random(4)
    for _ in range(30):
        held = [[rng.randint(0, 2) for _ in range(rng.randint(1, 12))] for _ in range(3)]
        automaton = SuffixAutomaton()
        for h in held:
            automaton.add(h)
        asked = [rng.randint(0, 2) for _ in range(15)]
        inside = lambda x: any(h[s : s + len(x)] == x for h in held for s in range(len(h)))
        assert automaton.matching_statistics(asked) == [max(n for n in range(e + 2) if n == 0 or inside(asked[e + 1 - n : e + 1])) for e in range(15)]


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_near_components(spark, seed):
    rows = fx.corpus(seed)
    got = jaccard_components(fx.table(spark, rows).repartition(3))
    same(rows_of(got, "doc_id", "n_shingles", "component_id"), fx.near_components(rows)[0])


def test_near_copies_of_one_text(spark):
    import random

    rng = random.Random(9)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    rows = []
    for k in range(90):
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = f"edit{rng.randint(0, 30)}"
        rows.append((k * 3, " ".join(own)))
    got = jaccard_components(fx.table(spark, rows), common_least=2)
    same(rows_of(got, "doc_id", "n_shingles", "component_id"), fx.near_components(rows)[0])


def test_one_document_of_each_group_stays(spark):
    rows = fx.corpus(1)
    docs = fx.table(spark, rows)
    kept = keep_first_of_component(docs)
    assert kept.columns == docs.columns
    _, groups = fx.near_components(rows)
    want = len({g for g in groups if g is not None}) + sum(g is None for g in groups)
    assert kept.count() == want
    first = {}
    for (i, t), g in zip(rows, groups):
        if g is not None:
            first[g] = min(first.get(g, fx.LATE), fx.LATE if i is None else i)
    assert sorted(first.values()) == sorted(fx.LATE if r.doc_id is None else r.doc_id for r in kept.collect() if fx.shingles(r.text))


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = connected_components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.label for r in got.collect()} == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}


ITEMS = [(1, "alpha beta gamma delta"), (2, "one"), (20, "Two words, really; and THIRTEEN or more of them follow here: a b c d e f g h"), (3, None), (4, "..."), (None, "one two"), (2, "one"), (5, "é ü ñ É")]


@pytest.mark.parametrize("seed", [0, 1])
def test_contamination(spark, seed):
    rows = fx.corpus(seed)
    long_item = " ".join((rows[2][1] or "x y").split() * 3)
    items = [*ITEMS, (6, long_item[:400]), (7, max((t or "" for _, t in rows), key=len)[500:900])]
    extra = [(910, "say Alpha-beta gamma, delta!"), (911, "two words really AND thirteen or more of them follow here a b c d e f g h i"), (912, "É ü ñ é"), (913, "é ü ñ É")]
    docs, bench = fx.table(spark, rows + extra), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = fx.contamination(rows + extra, items)
    assert any(w[-1] for w in want)
    same(rows_of(decontaminate(docs, bench), *names), want)
    kept = keep_uncontaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[-1] for w in want)


def test_contamination_without_prefilter(spark, monkeypatch):

    monkeypatch.setattr(decontamination, "PREFILTER_PRINTS", 0)
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    rows = fx.corpus(2)
    items = [*ITEMS, (7, max((t or "" for _, t in rows), key=len)[500:900])]
    got = decontaminate(fx.table(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    same(rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), fx.contamination(rows, items))


def test_licences(spark):
    mit = next(t for k, t in KNOWN if k == "MIT" and len(t) > 500)
    rows = [(1, mit.upper().replace(",", " ;")), (2, "Copyright (c) 2020 Me\nAll rights reserved.\n" + mit), (3, "some text\n  Released under the MIT licence.  \nmore"), (4, None), (5, ""), (6, "Copyright 1999"), (3, "some text\n  Released under the MIT licence.  \nmore"), (None, "licensed under cc by nc 4.0"), (7, mit + " and more")]
    got = scan_licences(fx.table(spark, rows), spark.createDataFrame([*KNOWN, (None, "x"), ("Z", "released under the mit license")], "license_id string, text string"))
    same(rows_of(got, "doc_id", "license_id", "n_notices", "notices"), [(1, "MIT", 0, ""), (2, "MIT", 0, ""), (3, None, 1, "MIT"), (3, None, 1, "MIT"), (4, None, 0, ""), (5, None, 0, ""), (6, None, 0, ""), (None, "CC-BY-NC-4.0", 1, "CC-BY-NC-4.0"), (7, None, 0, "")])


def test_licences_in_their_published_line_breaks(spark):
    import textwrap

    def wrapped(text, width):
        return "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))

    isc = next(t for k, t in KNOWN if k == "ISC").replace("that the above copyright", "that the above\ncopyright")
    whole = [(k, t) for k, t in KNOWN if len(t) > 300]
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC", "0BSD", "Zlib", "BSL-1.0", "Unlicense"} <= {k for k, _ in whole}
    asked = [*whole, ("ISC", isc), ("ISC", "Copyright Jane Doe\n" + isc)]
    styles = [("", "", ""), ("", "# ", ""), ("", "// ", ""), ("/*\n", " * ", "\n */"), ("<!--\n", "", "\n-->")]
    for n, (k, t) in enumerate(whole):
        for w in range(50, 101):
            before, mark, after = styles[(n + w) % len(styles)]
            asked.append((k, before + "\n".join(mark + line for line in wrapped(t, w).split("\n")) + after))
    got = scan_licences(fx.table(spark, [(n, t) for n, (_, t) in enumerate(asked)]), spark.createDataFrame(KNOWN, "license_id string, text string"))
    assert {r.doc_id: r.license_id for r in got.collect()} == {n: k for n, (k, _) in enumerate(asked)}


def test_titles_notices_and_appendices_are_optional(spark):
    text = {k: t for k, t in KNOWN if len(t) > 300}
    mit, apache, bsd = (text[k][text[k].index(start) :] for k, start in (("MIT", "Permission"), ("Apache-2.0", "TERMS AND"), ("BSD-3-Clause", "Redistribution")))
    bare = apache[: apache.index("END OF TERMS") + len("END OF TERMS AND CONDITIONS")]
    gpl = text["GPL-3.0"]
    asked = [
        ("MIT", mit), ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2019-2021 Some Very Long Name of a Company and\nits many Contributors, Inc.\n\n" + mit), ("MIT", "MIT License\nCopyright (c) 2020 X\n" + mit), ("MIT", "Portions Copyright 1999 A. Person\nCopyright (C) 2000 B\nAll rights reserved. " + mit),
        ("Apache-2.0", bare), ("Apache-2.0", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\n" + bare), ("Apache-2.0", "Copyright 2021 The Authors\n\n" + text["Apache-2.0"]),
        ("BSD-3-Clause", "BSD 3-Clause License\n\n(c) 2018, Somebody\n" + bsd), ("GPL-3.0", gpl[: gpl.index("END OF TERMS") + len("END OF TERMS AND CONDITIONS")]),
        (None, "My program is good. " * 9 + mit), (None, mit + " And one more term."), (None, mit.replace("without restriction", "with restriction")), (None, "Copyright (c) 2020 X " + "word " * 100 + mit), (None, gpl.replace("END OF TERMS", "NOT THE END")), (None, "Copyright (c) 2020 Somebody. All rights reserved."),
    ]
    got = scan_licences(fx.table(spark, [(n, t) for n, (_, t) in enumerate(asked)]), spark.createDataFrame(KNOWN, "license_id string, text string"))
    assert {r.doc_id: r.license_id for r in got.collect()} == {n: k for n, (k, _) in enumerate(asked)}


def test_licences_equal_sql_on_known_texts(spark, tmp_path):
    """The SQL has a normaliser of its own."""
    from chromaweave.llm import queries
    from compare import assert_same, connect

    rows = [(n, "Copyright (c) 2001 Ä. Ö.\n" * (n % 3) + t[: len(t) - 10 * (n % 2)]) for n, (_, t) in enumerate(KNOWN)] + [(100, None), (101, "é\u0301 licences\nReleased under the MIT License.")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert_same(queries.op5_licences(spark, str(tmp_path)).toPandas(), connect(str(tmp_path)).execute(queries.ORACLES["op5_licences"]).df())


def test_empty_tables(spark):
    none = fx.empty(spark)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert token_counts(none, BPE).count() == 0
    assert remove_repeated_bytes(none).count() == 0 and cut_repeated_bytes(none).count() == 0
    assert remove_repeated_words(none).count() == 0
    assert jaccard_components(none).count() == 0 and keep_first_of_component(none).count() == 0
    assert decontaminate(none, bench).count() == 0
    assert scan_licences(none, spark.createDataFrame([], "license_id string, text string")).count() == 0
    docs = fx.table(spark, [(1, "a b"), (2, None)])
    assert decontaminate(docs, bench).where("n_hit > 0").count() == 0
    assert jaccard_components(docs.where("text IS NULL")).select("component_id").first()[0] == 2


def test_native_plans_run_no_python(spark):
    docs = fx.table(spark, fx.corpus(0))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for df in (decontaminate(docs, bench), scan_licences(docs, spark.createDataFrame(KNOWN, "license_id string, text string"))):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op5_licences", "op6_jaccard_join", "op8_substring_dedup", "op10_decontamination"])
def test_query_equals_sql(spark, name):
    from chromaweave.llm import queries
    from compare import assert_same, connect

    sf = "/root/testdata/sf0.001"
    assert_same(queries.QUERIES[name](spark, sf).toPandas(), connect(sf).execute(queries.ORACLES[name]).df())


def test_very_long_text(spark):
    text = "word " * 150_000 + "Ende "
    rows = [(1, text), (2, text + "x"), (3, "short")]
    docs = fx.table(spark, rows)
    assert {r.doc_id: r.n_removed for r in remove_repeated_bytes(docs).collect()} == {1: 0, 2: len(text), 3: 0}
    assert {r.doc_id: r.n_words for r in remove_repeated_words(docs).collect()} == {1: 150_001, 2: 150_002, 3: 1}
    assert {r.doc_id: r.n_tokens > 150_000 for r in token_counts(docs, BPE).collect()} == {1: True, 2: True, 3: False}
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()} == {(1, 2, 1), (2, 3, 2), (3, 1, 3)}
    bench = spark.createDataFrame([(1, "word " * 12 + "ende"), (2, "short")], "item_id long, text string")
    assert {(r.doc_id, r.n_words, r.n_hit) for r in decontaminate(docs, bench).collect()} == {(1, 150_001, 13), (2, 150_002, 13), (3, 1, 1)}
    found = scan_licences(docs, spark.createDataFrame([("W", text.upper())], "license_id string, text string"))
    assert {(r.doc_id, r.license_id) for r in found.collect()} == {(1, "W"), (2, None), (3, None)}


@pytest.mark.parametrize("most", [1, 1 << 22])
def test_equal_runs_meet_in_the_automata(spark, monkeypatch, most):
    """Copies over many tasks: whatever is removed comes from automata, but for runs equal word for word in one task."""
    from chromaweave.llm import repeats, substring_dedup

    cut = repeats._cut
    monkeypatch.setattr(repeats, "_cut", lambda w: cut(w, most_units=most))
    words = " ".join(f"w{k * k % 977}" for k in range(400))
    rows = [(k, words if k % 3 else f"own{k} {words} own{k}") for k in range(40)] + [(None, words), (7, words)]
    got = remove_repeated_words(fx.table(spark, rows).repartition(5), length=20)
    same(rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256"), fx.repeated_words(rows, 20))
    none = remove_repeated_words(fx.table(spark, [(1, words), (2, words + " x")]).repartition(2), length=20)
    assert {r.doc_id: r.n_removed for r in none.collect()} == {1: 0, 2: 400}
    assert substring_dedup.remove_repeated_words(fx.table(spark, [(1, words)])).first().n_removed == 0


def test_a_template_of_all_items_makes_no_pairs(spark):
    """300 documents and 3,000 items that begin with the same window, some documents with another item's words as well."""
    head = " ".join(f"w{k}" for k in range(13))
    rows = [(k, f"{head} d{k} end" + (f" {head} x{k} y{k} z{k}" if k % 100 == 0 else "")) for k in range(300)]
    items = [(k, f"{head} x{k} y{k} z{k}") for k in range(3000)]
    got = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(fx.contamination(rows, items))
    windows = decontamination._windows(spark.createDataFrame([(str(k), t.split()) for k, t in items], "item string, iw array<string>"), 13)
    assert windows.count() == 1 + 3 * 3000 and windows.select("set_key").distinct().count() == 3001


def test_texts_that_share_few_shingles_are_not_sent_to_each_other(spark, monkeypatch):
    """Pairs that the second look verifies have in common what similar sets must, not just one shingle of their prefixes."""
    from chromaweave.llm import jaccard_join

    held, keep = [], jaccard_join.shared_checkpoint

    def noted(df):
        out = keep(df)
        if out.columns == ["a", "b"]:
            held.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "shared_checkpoint", noted)
    passage = " ".join(f"same{k}" for k in range(8))
    rows = [(k, f"{passage} " + " ".join(f"w{k}x{j}" for j in range(40))) for k in range(60)] + [(100, " ".join(f"w7x{j}" for j in range(40)))]
    got = {r.doc_id: r.component_id for r in jaccard_components(fx.table(spark, rows), common_shingles=0).collect()}
    assert got == {k: k for k in range(60)} | {100: 7}
    first, _, second, _ = held  # pairs looked at and links found, twice
    assert first + second <= 10
