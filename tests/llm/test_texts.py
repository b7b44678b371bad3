"""Suffix dedup, n-gram join, packing, token output, quality rules and byte-level BPE against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpus import documents, plain, texts
from tracelode.llm import byte_bpe, components, ngram_join, packing, quality_rules, suffix_dedup, token_output, tokens
from tracelode.llm.store import written
from tracelode.llm.tokens import encoder, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = "word_bpe_49k.json"


def _repeats(rows: list[tuple[int | None, str | None]], length: int = 400) -> list[tuple]:
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc_id, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 1, np.int64)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        cut = np.cumsum(gone[:-1]) > 0
        kept = bytes(b for b, c in zip(d, cut, strict=True) if not c)
        out.append((doc_id, len(d), int(cut.sum()), int(np.count_nonzero(np.diff(np.concatenate(([0], cut.astype(int)))) == 1)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def _sets(rows):
    out = []
    for _, text in rows:
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
        out.append(frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else []))
    return out


def _components(rows):
    sets = _sets(rows)
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b)]
    group = list(range(len(rows)))
    while True:
        before = list(group)
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
        if group == before:
            break
    least = defaultdict(list)
    for i, g in enumerate(group):
        least[g].append(rows[i][0])
    name = {g: min((x for x in ids if x is not None), default=None) for g, ids in least.items()}
    return sorted(((rows[i][0], len(sets[i]), name[g] if sets[i] else rows[i][0]) for i, g in enumerate(group)), key=repr)


def test_repeats_of_awkward_rows(spark):
    found = suffix_dedup.remove_repeats(documents(spark))
    assert plain(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == _repeats(texts())


def test_repeats_of_a_whole_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert plain(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == _repeats(rows)


@pytest.mark.parametrize("size", [399, 400, 401, 799])
def test_repeats_at_the_limit(spark, size):
    base = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(size))
    rows = [(1, "A" + base + "B"), (2, "C" + base + "D"), (3, base)]
    assert plain(suffix_dedup.remove_repeats(documents(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == _repeats(rows)


@pytest.mark.parametrize("length", [17, 250])
def test_repeats_of_another_length(spark, monkeypatch, tiny, length):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(150)
    base = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(length + 1))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(-1, "A" + base[:length] + "B"), (-2, "C" + base[:length]), (-3, base[2:])]
    for group in (suffix_dedup.GROUP, 0):
        monkeypatch.setattr(suffix_dedup, "GROUP", group)
        found = suffix_dedup.remove_repeats(documents(spark, rows), length=length)
        assert plain(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == _repeats(rows, length)


def test_pipeline_cuts_passages_of_over_fifty_words(spark):
    import corpus_pipeline

    words = lambda seed: [hashlib.md5(f"{seed}-{i}".encode()).hexdigest()[: 2 + i % 7] for i in range(51)]
    passage = " ".join(words("p"))
    assert 250 < len(passage) < 400
    docs = documents(spark, [(k, " ".join([*words(k), f"end{k}", passage, f"{k}begin", *words(-k)])) for k in (1, 2, 3)]).select("doc_id", "text", "lang", "source", "n_chars")
    kept = {r["doc_id"]: r["text"].split() for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert kept == {k: [*words(k), f"end{k}{k}begin", *words(-k)] for k in (1, 2, 3)}


def test_many_different_runs_are_counted_by_digest(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 0)
    found = suffix_dedup.remove_repeats(documents(spark))
    assert plain(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == _repeats(texts())


def test_kept_text_and_empty_table(spark):
    found = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(documents(spark), ("doc_id", "node"), with_text=True).where("doc_id IS NOT NULL").collect()}
    assert found[5]["kept"] is None and found[6]["kept"] == "" and found[8]["kept"] == "one two" and found[1]["node"] == "x"
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=12), min_size=1, max_size=12))
def test_suffixes_are_sorted(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts])
    suffixes = suffix_dedup.Suffixes(data, np.cumsum(size) - size, size)
    order = suffixes.order(np.zeros(len(parts), np.int64))
    assert [parts[i] for i in order] == sorted(parts)


def test_join_of_awkward_rows(spark):
    assert plain(ngram_join.join_documents(documents(spark)), "doc_id", "n_shingles", "component_id") == _components(texts())


def test_join_of_a_whole_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert plain(ngram_join.join_documents(docs), "doc_id", "n_shingles", "component_id") == _components(rows)


def test_join_at_the_threshold(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words[:49]))] + [(k, " ".join(words[:49][:-k] + [f"z{k}{j}" for j in range(k)])) for k in range(2, 12)] + [(20, " ".join(words[:40])), (21, " ".join(words[:39])), (22, " ".join(words[5:49]))]
    assert plain(ngram_join.join_documents(documents(spark, rows)), "doc_id", "n_shingles", "component_id") == _components(rows)


def test_chain_of_near_copies(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 100])) for k in range(40)]
    found = plain(ngram_join.join_documents(documents(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert found == _components(rows) and {c for _, _, c in found} == {0}


def test_one_of_each_stays(spark):
    kept = ngram_join.keep_one_of_each(documents(spark))
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert kept.columns == documents(spark).columns
    assert ids.count(1) == 1 and 2 not in ids and 3 not in ids and 4 not in ids and 9 not in ids and {5, 6, 7, 8, 10}.issubset(set(ids)) and ids.count(None) == 2
    assert ngram_join.keep_one_of_each(documents(spark, [])).count() == 0


def _ids(text: str | None) -> list[int]:
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(BPE))
    library.encode_special_tokens = False
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(tiny):
    import pyarrow.parquet as pq

    column = pq.read_table(f"{tiny}/documents.parquet", columns=["text"]).column(0).combine_chunks().cast(pa.string())
    column = pa.concat_arrays([column, pa.array([t for _, t in texts()], pa.string()), pa.array(["<|endoftext|> a", "İstanbul's Ⅷ 1½", "a'b''c 'll'LL", "é é", "x­y​z\x01"], pa.string())])
    ids, sizes = encoder(tokenizer_path(BPE)).encode(column)
    ends = np.cumsum(sizes)
    for i, text in enumerate(column.to_pylist()):
        assert ids[ends[i] - sizes[i] : ends[i]].tolist() == _ids(text), text


def test_known_runs_are_not_learned_again(monkeypatch):
    """A piece whose runs are all known never makes the encoder start anew, however full it is."""
    known, learned = tokens.Encoder(tokenizer_path(BPE)), []
    learn = known._learn
    monkeypatch.setattr(tokens, "KEPT_RUNS", 6)
    monkeypatch.setattr(known, "_learn", lambda runs: learned.append(list(runs)) or learn(runs))
    for text, new in (("one two Tré's 7", 4), ("7 two one Tré's", 0), ("two three", 1), ("four five two six", 4)):
        learned.clear()
        ids, sizes = known.encode(pa.array([text, None]))
        assert ids.tolist() == _ids(text) and sizes.tolist() == [len(ids), 0]
        assert sum(map(len, learned)) == new


@pytest.mark.parametrize("operator", ["packing", "token_output"])
def test_idle_workers_keep_no_runs(spark, operator):
    path = tokenizer_path(BPE)
    made = packing.cut_documents(documents(spark), path) if operator == "packing" else token_output.frames(documents(spark), path, b"", None)
    assert made.count()

    def kept(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, encoder(path).n))], names=["n"])

    assert {r["n"] for r in spark.range(64, numPartitions=8).mapInArrow(kept, "n long").collect()} == {0}


def test_few_edges_are_few_files(spark, monkeypatch):
    """A round of components writes files by its edges, not by its shuffle partitions."""
    made = []
    monkeypatch.setattr(components, "written", lambda df, label: made.append(written(df, label)) or made[-1])
    monkeypatch.setattr(components, "FILE_EDGES", 40)
    edges = spark.createDataFrame([(k, k + 1) for k in range(100) if k % 10 != 9], "a long, b long")
    with_rounds = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert with_rounds == {k: k // 10 * 10 for k in range(100)}
    assert len(made) > 2 and all(len(df.inputFiles()) <= 3 for df in made[1:])


def test_a_fixed_table_is_one_job(spark):
    rows = spark.range(1000, numPartitions=4)
    spark.sparkContext.setJobGroup("fixed-table", "")
    table = ngram_join.fixed_table(rows, lambda batches: ((b.column(0).to_numpy() * 9973) % ngram_join.SLOTS for b in batches))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert table.sum() == 1000 and (table[(np.arange(1000) * 9973) % ngram_join.SLOTS] == 1).all()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("fixed-table")) <= 3


def test_packing(spark):
    rows = packing.pack_documents(documents(spark), tokenizer_path(BPE)).collect()
    wanted = Counter()
    for doc_id, text in texts():
        ids = [*_ids(text), 0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            wanted[(doc_id, k, s, len(ids[s : s + 2048]), zlib.crc32(struct.pack(f"<{len(ids[s : s + 2048])}I", *ids[s : s + 2048])))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack_documents(documents(spark, []), tokenizer_path(BPE)).count() == 0


def _best_fit(lengths: list[int], capacity: int) -> int:
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_plan_is_best_fit_decreasing(lengths):
    table = packing.plan(dict(Counter(lengths)), 40)
    used, total = set(), 0
    for length, _, n, first, each, offset in table.tolist():
        total += n
        for k in range(n):
            used.add(first + k // each)
            assert offset + (k % each + 1) * length <= 40
    assert total == len(lengths) and len(used) == _best_fit(lengths, 40)


def test_token_output_round_trip(spark):
    target = token_output.fresh_target(spark)
    docs = documents(spark)
    token_output.write_tokens(docs, target, tokenizer_path(BPE), end_id=1)
    rows = token_output.read_tokens(spark, target).collect()
    wanted = Counter((i, tuple([*_ids(t), 1])) for i, t in texts())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == wanted
    start = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"]))
        start += r["n_tokens"]
    ordered = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert [x for x in ordered if x is not None] == sorted(x for x in ordered if x is not None)
    assert token_output.read_document(spark, target, 8) == [[*_ids("one two"), 1]]
    empty = token_output.fresh_target(spark)
    token_output.write_tokens(documents(spark, []), empty, tokenizer_path(BPE), end_id=1)
    assert token_output.read_tokens(spark, empty).count() == 0


def _rule_counts(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), failed


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_counts(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "lang")
    rows = [*texts(), *[(r["doc_id"], r["text"]) for r in docs.collect()]]
    both = documents(spark, rows)
    found = quality_rules.score_documents(both, _labels(spark, [(1, 1, 0), (None, 1, 0), (2, None, 0)]))
    wanted = sorted(((i, *_rule_counts(t)) for i, t in rows), key=repr)
    assert plain(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == wanted
    assert not found.where("kept AND base_failed").count()
    assert quality_rules.score_documents(documents(spark, []), _labels(spark, [])).count() == 0


def test_cutoffs_limit_false_rejection(spark, tiny):
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    found = quality_rules.score_documents(docs, labels).join(labels, "doc_id")
    good = found.where("quality = 1 AND NOT base_failed")
    assert good.where("NOT kept").count() <= 0.05 * good.count()
    kept = quality_rules.keep_good(documents(spark), labels)
    assert kept.columns == documents(spark).columns and {5, 6, 7}.isdisjoint({r["doc_id"] for r in kept.collect()})


@pytest.mark.parametrize(("k", "n", "delta"), [(0, 50, 0.05), (3, 100, 0.01), (10, 40, 0.001)])
def test_binomial_limit_is_exact(k, n, delta):
    from math import comb

    p = quality_rules.binomial_upper(k, n, delta)
    assert abs(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - delta) < 1e-9


def test_byte_bpe_equals_library(spark):
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*texts(), (89, "a" * 700 + " " * 300 + "é" * 200), (90, "tab\t\tand wide  spaces   end  "), (91, "\u0085x ᠎y ͏ z"), (92, "ÀÉ漢字١٢٣ ½ <|endoftext|>")]
    found = {}
    for r in byte_bpe.encode_documents(documents(spark, rows), ranks, public_tokenizers.PATTERN, most=20).collect():
        found.setdefault((r["doc_id"], bytes(r["decoded"])), []).append((list(r["ids"]), r["n_tokens"]))
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        assert (ids, len(ids)) in found[(doc_id, (text or "").encode())], text
    assert byte_bpe.encode_documents(documents(spark, []), ranks, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_query_over_a_whole_table(spark, tiny):
    import hashlib

    import public_tokenizers
    import tiktoken

    from tracelode.llm.queries import QUERIES

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    texts_ = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op9_byte_bpe"](spark, tiny).collect()
    assert len(rows) == len(texts_)
    for r in rows:
        ids = library.encode_ordinary(texts_[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(",".join(map(str, ids)).encode()), digest(texts_[r["doc_id"]].encode()))


def test_byte_bpe_of_long_words_and_every_script(spark):
    """A word of 100,000 letters, and letters and numbers of every script beside a letter: ids equal the library's."""
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(4)
    # The last byte of these characters merges with a letter, so their class shows in the ids.
    signs = [chr(c) for c in range(0xA7, 0x110000) if chr(c).encode("utf-8", "ignore")[-1:] == b"\xa7"]
    rows = [(1, "".join(draw.choice("abeinst") for _ in range(100_000))), (2, "".join(f"{c}a1{c}! " for c in signs)), (3, " ".join("".join(draw.choice("abeinsté") for _ in range(draw.randint(1, 200))) for _ in range(400)))]
    for most in (1, byte_bpe.READY):
        found = {r["doc_id"]: list(r["ids"]) for r in byte_bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), ranks, public_tokenizers.PATTERN, most=most).collect()}
        assert found == {k: library.encode_ordinary(t) for k, t in rows}


def test_every_pair_has_its_own_place():
    pairs = {(a, b): a * 7 + b for a in range(60) for b in range(0, 90, 3)}
    shifts, table = byte_bpe.place_pairs(pairs)
    for (a, b), rank in pairs.items():
        k = a << byte_bpe.ID_BITS | b
        assert table[(k ^ shifts[k % len(shifts)]) % len(table)] == k << byte_bpe.ID_BITS | rank
    assert byte_bpe.place_pairs({})[1].count(1 << 62) == 7


def test_cutoffs_are_the_sharpest_that_the_bound_allows(spark):
    """Against a plain fit: binomial tails summed with exact binomial coefficients, cutoffs tried from mild to sharp."""
    from math import comb, log

    draw = random.Random(8)
    good = ["plain words stand here in a row of ten or more than that " + " ".join(draw.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(draw.randint(5, 30))) + (" #" * draw.randint(1, 9) if k % 400 == 0 else "") for k in range(2400)]
    bad = ["plain # words # stand # here # in $ a % row & of * ten < or > more " + str(k) for k in range(50)]
    rows = [(k, t, "en" if k % 2400 < 2000 or k >= 2400 else "de") for k, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k < 2400), 0) for k, _, _ in rows], "doc_id long, quality int, toxic int")
    scored = quality_rules.score_documents(docs, labels).collect()
    assert len(scored) == len(rows)

    def value(r, rule):
        above, below, _, _ = quality_rules.RULES[rule]
        return r[above] / r[below] if r[below] else None

    def rejects(r, rule, cutoff):
        v = value(r, rule)
        return v is not None and (v > cutoff if quality_rules.RULES[rule][2] > 0 else v < cutoff)

    lang, text = {k: x for k, _, x in rows}, {k: t for k, t, _ in rows}
    level, share = 0.05 / (6 * 2), 0.05 / 6
    expected, seen = {}, set()
    trials = {"en": [], "de": []}
    for r in scored:
        if r["doc_id"] < 2400 and not r["base_failed"] and (lang[r["doc_id"]], text[r["doc_id"]]) not in seen:
            seen.add((lang[r["doc_id"]], text[r["doc_id"]]))
            trials[lang[r["doc_id"]]].append(r)
    for name, own in trials.items():
        for rule, (_, _, _, grid) in quality_rules.RULES.items():
            for cutoff in reversed(grid):
                k, n = sum(rejects(r, rule, cutoff) for r in own), len(own)
                # The upper limit is at most `share` where so few rejections are as unlikely as the level at that rate.
                if k > 60 or sum(comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1)) > level:
                    break
                expected[name, rule] = cutoff
    assert ("en", "symbols") in expected and not any(name == "de" for name, _ in expected) and log(level) / log(1 - share) > 400
    for r in scored:
        name = lang[r["doc_id"]]
        kept = not r["base_failed"] and not any(rejects(r, rule, expected[name, rule]) for rule in quality_rules.RULES if (name, rule) in expected)
        assert r["kept"] == kept, r
    assert sum(not r["kept"] and not r["base_failed"] for r in scored if r["doc_id"] >= 2400) == 50
    stays = {r["doc_id"] for r in quality_rules.keep_good(docs, labels).collect()}
    assert stays == {r["doc_id"] for r in scored if r["kept"]}
