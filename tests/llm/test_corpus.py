"""The corpus operators against brute force, on small tables with nulls, empties, ties, repeats and clashing names."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablemill.llm import byte_bpe, chat, common, exact_dedup, graph, packing, quality, simhash, substring_dedup, suffix_array, token_shards, toxicity, word_tokens
from tablemill.llm import queries as Q

from test_near_copies import kept_of

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, kept string, __sw_k long, fingerprint string, score string, keep_id string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def rows_of(rng):
    """Documents with copies, near copies, shared passages, long ones, empty ones and nulls."""
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(60)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = words(70)
    texts = [" ".join(words(rng.randint(0, 160))) for _ in range(30)]
    texts += [" ".join([*words(rng.randint(0, 60)), *passage[rng.randint(0, 12) :], *words(rng.randint(0, 60))]) for _ in range(25)]
    texts += [texts[rng.randrange(len(texts))] for _ in range(15)]
    for _ in range(15):
        w = texts[rng.randrange(len(texts))].split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append("\n".join(w))
    texts += ["", "", None, "  \t\n", "x", "a" * 400, "a" * 300, " ".join(["same"] * 200)]
    ids = rng.sample(range(1000), len(texts))
    rows = [(i, t) for i, t in zip(ids, texts, strict=True)]
    rows += [rows[3], rows[40], (rows[5][0], "another text of a repeated id"), (None, texts[0]), (None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return rows_of(random.Random(5))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, "f", "s", "x") for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- exact dedup


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, rows, keep, monkeypatch):
    for part in (exact_dedup.HOT_PART, 1e9):  # with and without salted texts
        monkeypatch.setattr(exact_dedup, "HOT_PART", part)
        hot_rows = rows + [(2000 + i, "hot") for i in range(300)]
        groups = defaultdict(list)
        for i, t in hot_rows:
            groups[t or ""].append(i)
        order = (lambda x: (x is not None, x)) if keep == "smallest" else (lambda x: (x is not None, x))
        pick = min if keep == "smallest" else max
        want = Counter((i, pick(groups[t or ""], key=lambda x: order(x) if x is not None else (False, 0)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in hot_rows)
        got = exact_dedup.mark_copies(frame(spark, hot_rows), keep=keep).select("doc_id", "keep_id", "group_size", "text_sha256", "kept").collect()
        assert Counter(tuple(r[:4]) for r in got) == want
        assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    assert exact_dedup.mark_copies(empty(spark)).count() == 0


def test_exact_dedup_is_native(spark, rows):
    plan = exact_dedup.mark_copies(frame(spark, rows))._jdf.queryExecution()
    assert not re.search("Python|Pandas|Arrow", plan.toString())
    assert re.findall(r"Exchange (\w+)", plan.executedPlan().toString()) == ["rangepartitioning"]


# --- quality


def base_metrics(text):
    words = WORD.findall(text or "")
    windows = defaultdict(list)
    for a in range(len(words) - 4):
        windows[tuple(words[a : a + 5])].append(a)
    covered = {a + k for at in windows.values() if len(at) > 1 for a in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, rows):
    more = rows + [(3000, "a b c d e\n" * 9), (3001, "Ü#x é|y\n" * 30), (3002, "one two three four five six seven eight nine ten")]
    got = quality.quality(frame(spark, more)).collect()
    want = Counter((i, *base_metrics(t)) for i, t in more)
    assert Counter(tuple(r[c] for c in ("doc_id", *quality.METRICS)) for r in got) == want
    for r in got:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    verdicts = [sorted(map(str, ((r["doc_id"], r["kept"]) for r in quality.quality(frame(spark, more), list(order)).collect()))) for order in (quality.RULES, reversed(quality.RULES))]
    assert verdicts[0] == verdicts[1]
    assert quality.quality(empty(spark)).count() == 0


def test_quality_orders_rules_by_rejections_per_cost(spark):
    order = quality.plan(Q.documents(spark, "/root/testdata/sf0.01"))
    assert sorted(order) == sorted(quality.RULES)
    names = list(quality.RULES)
    dear, cheap = [4.0, 1.0, 1.0, 1.0, 1.0, 1.0], [0.1] * 6
    bit = lambda *ks: sum(1 << k for k in ks)
    # Rule 0 rejects most but is dear; rule 1 rejects 30 that rule 2 rejects too; rule 3 rejects 10 others.
    kinds = [(bit(0), 44, [44 * x for x in dear]), (bit(1, 2), 30, [30 * x for x in dear]), (bit(2), 5, [5 * x for x in dear]), (bit(3), 10, [10 * x for x in dear]), (0, 100, [100 * x for x in dear])]
    assert quality.order_rules(kinds)[:4] == [names[k] for k in (2, 0, 3, 1)]
    assert quality.order_rules([]) == names and quality.order_rules([(0, 9, cheap)]) == names
    assert quality.measure(["too short", "x " * 40]) == []


def test_quality_keeps_clean_documents():
    clean = "The quick brown fox jumps over the lazy dog while a small bird sings above the quiet river at dawn."
    assert not any(rule(clean, quality._base(clean)) for rule in quality.RULES.values())


# --- byte-level BPE


def encoding():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})


def test_byte_bpe(spark, rows):
    path, pattern, known = encoding()
    odd = ["a" * 500, " " * 90 + "x", "日本語 🎉 it's", "\x00", "ab" * 48, "ab" * 49, "<|endoftext|>"]
    docs = frame(spark, rows + [(5000 + k, t) for k, t in enumerate(odd)])
    got = byte_bpe.encode(docs, path, pattern).collect()
    for r in got:
        text = r["text"] or ""
        assert r["ids"] == known.encode_ordinary(text) and bytes(r["decoded"]) == text.encode() and r["n_tokens"] == len(r["ids"])
    back = byte_bpe.decode(byte_bpe.encode(docs, path, pattern).select("text", "ids"), path, pattern).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back)
    assert byte_bpe.encode(empty(spark), path, pattern).count() == 0


def test_long_words_merge_alike():
    path, pattern, known = encoding()
    model, rng = byte_bpe.ByteBPE(path, pattern), random.Random(1)
    for _ in range(20):
        word = "".join(rng.choices("abeinrst", k=rng.randint(2, 90))).encode()
        assert model._merge_long(word) == model.encode_words([word])[0].tolist()


# --- words' tokens, packing, shards


def tokenizer():
    return Q.tokenizer("word_bpe_49k.json")


def ids_of(texts):
    model = word_tokens.load(tokenizer()).model
    return [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def test_word_tokens(rows):
    odd = ["ΑΣ ΣΑΣ. Σ", "a\x1cb c　d", "don't. x's' 'll", "Étude ﬁ İstanbul. İ", "<|endoftext|>.", "foo!! a.b. 12,3.", "abc'.", "été's!", "ǅ ẞ ὈΔΥΣΣΕΎΣ", "ñ", "한국어 텍스트"]
    texts = [t or "" for _, t in rows] + odd
    model = word_tokens.WordTokens(tokenizer(), 50)  # a cache that keeps starting anew
    got = [np.frombuffer(x, "<u4").tolist() for k in range(0, len(texts), 7) for x in model.batch(texts[k : k + 7])]
    assert got == ids_of(texts)


def test_packing(spark, rows):
    docs = rows + [(4000, "word " * 700)]
    got = packing.pack_documents(frame(spark, docs), tokenizer(), capacity=256).collect()
    want = Counter()
    for (i, t), ids in zip(docs, ids_of([t or "" for _, t in docs]), strict=True):
        ids = [*ids, 0]
        for k, a in enumerate(range(0, len(ids), 256)):
            part = ids[a : a + 256]
            want[i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r[:5]) for r in got) == want
    for _, own in itertools.groupby(sorted(got, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    counts = Counter(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= sum(n for _, n in packing.best_fit(counts, 256))
    assert packing.pack_documents(empty(spark), tokenizer()).count() == 0


def test_bin_completion_is_at_least_best_fit():
    rng = random.Random(3)
    for _ in range(40):
        counts = Counter(rng.randint(1, 60) for _ in range(rng.randint(1, 80)))
        plan = packing.bin_completion(counts, 60)
        used = Counter()
        for pattern, times in plan:
            assert sum(pattern) <= 60
            used.update({k: times * n for k, n in Counter(pattern).items()})
        assert used == counts
        assert sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit(counts, 60))
    assert sum(n for _, n in packing.bin_completion({30: 4, 20: 6}, 60)) == 4


def test_feistel_is_a_permutation():
    for n in (0, 1, 2, 3, 17, 64, 1000):
        for key in (1, 2):
            assert sorted(token_shards.slots(np.arange(n), n, key)) == list(range(n))
    assert list(token_shards.slots(np.arange(50), 50, 1)) != list(token_shards.slots(np.arange(50), 50, 2))


def test_token_shards(spark, rows, tmp_path):
    docs = frame(spark, rows).repartition(5).cache()
    path = str(tmp_path / "shards")
    written = common.cut(token_shards.write_shards(docs, path, tokenizer(), per_shard=16, record=64))
    got = token_shards.read_index(spark, written, path).collect()
    assert sorted(r["slot"] for r in got) == list(range(len(rows)))
    want = Counter((i, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u2").tobytes())) for (i, _), ids in zip(rows, ids_of([t or "" for _, t in rows]), strict=True))
    assert Counter((r["doc_id"], r["n_ids"], r["ids_crc32"]) for r in got) == want
    for f in (tmp_path / "shards").glob("*.bin"):
        assert f.stat().st_size % 128 == 0
    whole, resumed = list(token_shards.read_shard(path, 1)), list(token_shards.read_shard(path, 1, from_slot=20))
    assert [x[0] for x in whole] == list(range(16, 32)) and [x[0] for x in resumed] == list(range(20, 32))
    assert all((a[3] == b[3]).all() for a, b in zip(whole[4:], resumed, strict=True))
    assert token_shards.write_shards(empty(spark), str(tmp_path / "none"), tokenizer()).count() == 0
    again = common.cut(token_shards.write_shards(docs, path, tokenizer(), per_shard=16, record=64))  # over existing files
    assert Counter(map(tuple, token_shards.read_index(spark, again, path).collect())) == Counter(map(tuple, got))
    assert not [f for f in (tmp_path / "shards").iterdir() if f.suffix not in (".bin", ".idx")]


def test_wide_ids_are_refused(spark, tmp_path, monkeypatch):
    docs = frame(spark, [(1, "a b")]).repartition(1)
    with pytest.raises(Exception, match="16 bits"):
        token_shards.write_shards(docs, str(tmp_path / "wide"), tokenizer(), end_id=70_000).count()
    assert not list((tmp_path / "wide").glob("*")) if (tmp_path / "wide").exists() else True


# --- near copies


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(text)
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def parts(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_simhash(spark, rows):
    prints = [fingerprint(t) for _, t in rows]
    label = parts(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = Counter((i, f"{p:016x}", least.get(c)) for (i, _), p, c in zip(rows, prints, label, strict=True))
    got = simhash.mark_near_copies(frame(spark, rows)).select("doc_id", "fingerprint", "component_id").collect()
    assert Counter(map(tuple, got)) == want
    kept = simhash.near_dedup(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and kept.count() == sum(1 for (i, _), c in zip(rows, label, strict=True) if least.get(c) in (None, i))
    assert simhash.mark_near_copies(empty(spark)).count() == 0


def test_hot_fingerprints_join_apart(spark):
    """A fingerprint of a third of the rows, one that few have, links between both kinds, and null doc_ids."""
    rng = random.Random(10)
    prints = [0] * 300 + [3] * 2 + [rng.getrandbits(62) for _ in range(400)] + [-1] * 150 + [-2]
    rows = [(k, f) for k, f in zip(rng.sample(range(5000), len(prints)), prints, strict=True)] + [(None, 0), (None, 77 << 40)]
    labels = {}
    for k, f in rows:
        for g in {f for _, f in rows if ((f ^ prints[0]) & (2**64 - 1)).bit_count() <= 4} if f in (0, 3) else {-1, -2} if f in (-1, -2) else {f}:
            labels[g] = min((x for x in (labels.get(g), k) if x is not None), default=None)
    got = simhash.with_components(spark.createDataFrame(rows, "doc_id long, fp long").repartition(7)).collect()
    assert len(got) == len(rows)
    assert all(r["component_id"] == labels[r["fp"]] for r in got)


@pytest.mark.parametrize("unit_rows", [4096, 40])
def test_dense_fingerprints(spark, monkeypatch, unit_rows):
    """Many fingerprints around a few centres; small units force large ones apart."""
    monkeypatch.setattr(simhash, "UNIT_ROWS", unit_rows)
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(4)]
    prints = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centres for _ in range(120)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    label = parts(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    fps = spark.createDataFrame([(f, k) for k, f in enumerate(signed)], "fp long, doc_id long")
    got = {r["fp"]: r["component_id"] for r in simhash.components_of(fps).collect()}
    assert [got[f] for f in signed] == label
    links = simhash.fingerprint_links(fps).count()
    assert links < 16 * len(prints)  # joins of parts, not pairs


@pytest.mark.parametrize("n_blocks", [6, 7, 8, 10])
def test_blocks_reach_every_link(spark, n_blocks):
    rng = random.Random(n_blocks)
    masks = simhash._masks(n_blocks)
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & flips == 0 for m in (m % 2**64 for m in masks))
    assert simhash.blocks_for(1000) == 6 and simhash.blocks_for(10**9) == 7 and simhash.blocks_for(10**10) == 8
    centre = rng.getrandbits(64)
    prints = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(80)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(f, None if k % 7 == 0 else k) for k, f in enumerate(signed)], "fp long, doc_id long")
    got = graph.components(simhash.fingerprint_links(fps, n_blocks)).collect()
    label = parts(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    groups = defaultdict(set)
    for r in got:
        groups[r["component"]["fp"]].add(r["node"]["fp"])
    want = defaultdict(set)
    for f, c in zip(signed, label, strict=True):
        want[c].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_own_columns_come_back(spark):
    """Columns of the caller with names that the operators use inside."""
    names = ["fp", "_fp", "_key", "__sw_k", "__sw_th", "__ed_n", "__ed_h", "__ed_p", "__ed_s", "hh", "salts", "wh", "ws", "slot", "least", "node", "TH"]
    long = " ".join(f"w{k}" for k in range(90))
    docs = spark.createDataFrame([(k, t, *[f"{n}{k}" for n in names]) for k, t in enumerate([long, long, "x " + long, "a b", None, *["hot"] * 60])], ["doc_id", "text", *names])
    want = sorted(tuple(r) for r in docs.select("doc_id", *names).collect())
    for marked in (simhash.mark_near_copies(docs), exact_dedup.mark_copies(docs), quality.quality(docs), substring_dedup.remove_substrings(docs), suffix_array.remove_repeats(docs)):
        assert sorted(tuple(r) for r in marked.select("doc_id", *names).collect()) == want
    for fewer in (simhash.near_dedup(docs), exact_dedup.exact_dedup(docs)):
        got = [tuple(r) for r in fewer.select("doc_id", *names).collect()]
        assert fewer.columns == docs.columns and set(got) < set(want) and len(set(got)) == len(got)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(300, k) for k in range(301, 360)] + [(k, k + 1) for k in range(400, 440)] + [(None, 1), (7, 7)]
    label = parts(500, [e for e in edges if None not in e])
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: label[x] for a, b in edges if None not in (a, b) and a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- shared passages


def without_shared(rows, words):
    first, symbols = {}, []
    for i, t in rows:
        raw = (t or "").encode()
        symbols.append(raw.split() if words else raw)
        for a in range(len(symbols[-1]) - 49) if i is not None else ():
            w = tuple(symbols[-1][a : a + 50])
            first[w] = min(i, first.get(w, i))
    out = Counter()
    for (i, _), s in zip(rows, symbols, strict=True):
        gone = {b for a in range(len(s) - 49) if i is not None and first[tuple(s[a : a + 50])] < i for b in range(a, a + 50)}
        kept = [x for k, x in enumerate(s) if k not in gone]
        spans = sum(1 for k in gone if k - 1 not in gone)
        digest = hashlib.sha256(b" ".join(kept) if words else bytes(kept)).hexdigest()
        out[(i, len(s), len(gone), digest) if words else (i, len(s), len(gone), spans, digest)] += 1
    return out


@pytest.mark.parametrize("many", [1000, 1])
def test_substring_dedup(spark, rows, many):
    got = substring_dedup.remove_substrings(frame(spark, rows), digest=True, many=many).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    want = without_shared(rows, True)
    assert sum(k[2] > 0 for k in want) > 20
    assert Counter(map(tuple, got)) == want
    assert substring_dedup.remove_substrings(empty(spark)).count() == 0


@pytest.mark.parametrize("many", [1000, 1])
def test_suffix_array_dedup(spark, rows, many):
    got = suffix_array.remove_repeats(frame(spark, rows), digest=True, many=many).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = without_shared(rows, False)
    assert sum(k[2] > 0 for k in want) > 20
    assert Counter(map(tuple, got)) == want
    assert suffix_array.remove_repeats(empty(spark)).count() == 0


def test_pieces_of_long_texts(spark, rows, monkeypatch):
    from tablemill.llm import shared_windows

    text, kind = " ".join(t or "" for _, t in rows), substring_dedup.KIND
    whole = shared_windows._Found([kind.raw(text)], kind, False)
    monkeypatch.setattr(shared_windows, "CHUNK_BYTES", 1600)
    cut = shared_windows._Found([kind.raw(text)], kind, False)
    assert set(zip(whole.pos.tolist(), whole.h.tolist(), strict=True)) <= set(zip(cut.pos.tolist(), cut.h.tolist(), strict=True))


def test_maximal_repeats():
    rng = random.Random(4)
    for _ in range(60):
        segments = [bytes(rng.choices(b"ab", k=rng.randint(0, 30))) for _ in range(rng.randint(1, 5))]
        least = rng.randint(1, 6)
        found = defaultdict(list)
        for s, x in enumerate(segments):
            for a in range(len(x)):
                for b in range(a + least, len(x) + 1):
                    found[x[a:b]].append((s, a))
        want = set()
        for w, at in found.items():
            left = {segments[s][a - 1] if a else (s, "^") for s, a in at}
            right = {segments[s][a + len(w)] if a + len(w) < len(segments[s]) else (s, "$") for s, a in at}
            if len(left) > 1 and len(right) > 1:
                want.add((len(w), tuple(at)))
        assert {(n, tuple(sorted(at))) for n, at in suffix_array.repeat_groups(segments, least)} == want


def test_automaton():
    rng = random.Random(6)
    for _ in range(60):
        texts = [rng.choices("abc", k=rng.randint(0, 25)) for _ in range(4)]
        a = substring_dedup.Automaton()
        for k, t in enumerate(texts):
            a.add(t, k)
        a.close()
        probe = rng.choices("abcd", k=30)
        want = []
        for end in range(4, len(probe) + 1):
            owners = [k for k, t in enumerate(texts) if any(t[i : i + 4] == probe[end - 4 : end] for i in range(len(t)))]
            if owners:
                want.append((end, min(owners)))
        assert list(a.matches(probe, 4)) == want


def test_reference(spark, rows):
    reference = spark.createDataFrame([(rows[45][1],), (None,)], "text string")
    got = substring_dedup.remove_reference(frame(spark, rows), reference).collect()
    assert sum(r["removed_spans"] != "[]" for r in got) >= 15
    assert next(r["kept_text"] for r in got if r["doc_id"] == rows[45][0] and r["text"] == rows[45][1]) == ""


# --- toxicity


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    model = toxicity.Model(into=0.3, out=-0.4, stay=1.1)
    odds = [np.exp(rng.normal(size=n)) for n in (0, 1, 2, 5, 8)]
    for o, p in zip(odds, toxicity.marginals(odds, model), strict=True):
        total, hits, want, pairs = 0.0, np.zeros(len(o)), np.zeros(3), np.zeros(3)
        for tags in itertools.product((0, 1), repeat=len(o)):
            w = np.prod([o[k] for k, t in enumerate(tags) if t] or [1.0])
            for a, b in zip(tags, tags[1:], strict=False):
                w *= np.exp({(0, 1): model.into, (1, 0): model.out, (1, 1): model.stay}.get((a, b), 0.0))
            total += w
            hits += w * np.array(tags, float)
            want += w * np.array([sum(x == y for x in zip(tags, tags[1:], strict=False)) for y in ((0, 1), (1, 0), (1, 1))])
        assert np.allclose(p, hits / total)
        toxicity.marginals([o], model, pairs)
        assert np.allclose(pairs, want / total)


def test_fit_follows_the_likelihood():
    """The gradient that the fit takes against differences of the log-likelihood, on a small chain."""
    rng = np.random.default_rng(3)
    odds, tags = [np.exp(rng.normal(size=n)) for n in (4, 6)], [rng.integers(0, 2, n) for n in (4, 6)]

    def likelihood(into, out, stay):
        whole = 0.0
        for o, y in zip(odds, tags, strict=True):
            def weight(t):
                return np.prod([o[k] for k, x in enumerate(t) if x] or [1.0]) * np.exp(sum({(0, 1): into, (1, 0): out, (1, 1): stay}.get(p, 0.0) for p in zip(t, t[1:], strict=False)))
            whole += np.log(weight(tuple(y))) - np.log(sum(weight(t) for t in itertools.product((0, 1), repeat=len(o))))
        return whole

    at = np.array([0.2, -0.3, 0.5])
    expected = np.zeros(3)
    toxicity.marginals(odds, toxicity.Model(into=at[0], out=at[1], stay=at[2]), expected)
    seen = np.array([sum(p == q for y in tags for p in zip(y.tolist(), y[1:].tolist(), strict=False)) for q in ((0, 1), (1, 0), (1, 1))])
    for k in range(3):
        step = np.eye(3)[k] * 1e-5
        assert abs((likelihood(*(at + step)) - likelihood(*(at - step))) / 2e-5 - (seen - expected)[k]) < 1e-4


def test_empty_and_very_long_texts_score(spark):
    assert toxicity.train(empty(spark), spark.createDataFrame([], "doc_id long, toxic int")).weights == {}
    model = toxicity.Model(weights={b"vile": 9.0})
    long = "calm " * 1_500_000 + "vile"
    docs = spark.createDataFrame([(1, long), (2, "vile"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert [tuple(x) for x in got[1]["spans"]] == [(len(long) - 4, len(long))] and got[3]["spans"] == []


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = Q.op10_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    right = Counter(map(tuple, got))
    assert right[1, 1] > 0.9 * (right[1, 1] + right[0, 1]) and right[1, 0] <= 0.01 * (right[0, 0] + right[1, 0])


def test_toxic_spans(spark):
    rng = random.Random(0)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=40) + ["Vilest"] * (k % 2) + rng.choices(words, k=40) + ["vilest"] * (k % 2)) for k in range(200)]
    model = toxicity.fit(texts, [k % 2 for k in range(200)])
    docs = spark.createDataFrame([(1, "Ähm the VILEST, of"), (2, None), (None, ""), (4, "plain")], "doc_id long, text string")
    got = toxicity.score_toxicity(docs, model).collect()
    assert [[tuple(s) for s in r["spans"]] for r in got] == [[(8, 14)], [], [], []]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_toxicity(empty(spark), model).count() == 0


def test_training_ignores_held_out_labels(spark):
    docs = spark.createDataFrame([(i, f"w{i} vile") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(30) if zlib.crc32(str(i).encode()) % 3 == 1] + [(None, 1), (2, None)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels).weights == {}


def test_training_counts_a_repeated_document_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.append((sorted(texts), sorted(labels))))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1][:4]
    docs = frame(spark, [(ids[0], "a")] * 50 + [(ids[0], "b"), (ids[1], None), (ids[2], "w " * 200), (ids[3], ""), (None, "c")])
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)] * 2, "doc_id long, toxic int")
    toxicity.train(docs, labels, fit_chars=100)
    assert seen == [(["", "a"], [0, 1])]


# --- chat


def cheapest(roles):
    """Least cost over every labelling, by walking the automaton with empty turns put in."""

    def step(state, to):
        best, todo = None, [(state, 0)]
        while todo:
            s, cost = todo.pop(0)
            for t in chat.NEXT[s]:
                if t == to:
                    return cost if best is None else best
                if cost < 3 * chat.INSERT:
                    todo.append((t, cost + chat.INSERT))
        return chat.FAR

    best = chat.FAR
    for states in itertools.product((1, 2, 3), repeat=len(roles)):
        cost, at = 0, chat.START
        for role, s in zip(roles, states, strict=True):
            cost += int(chat._label(role)[s]) + (min(chat.MERGE, step(at, s)) if at == s else step(at, s))
            at = s
        best = min(best, cost + {1: 2 * chat.INSERT, 2: chat.INSERT, 3: 0}[at])
    return best


@pytest.mark.parametrize("chunk", [4096, 3])
def test_chat(spark, chunk):
    rng = random.Random(8)
    convs = {k: [rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None]) for _ in range(rng.randint(1, 7))] for k in range(40)}
    convs |= {100: ["user", "assistant"], 101: ["system", "user", "assistant"], 102: ["assistant"]}
    turns = [(c, n, r, f"t{n}", "extra") for c, roles in convs.items() for n, r in enumerate(roles)] + [(None, None, None, None, "x"), (None, 1, "user", "u", "x")]
    got = defaultdict(list)
    for r in chat.repair(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, rendered string"), chunk).collect():
        got[r["conv_id"]].append(r)
    assert {c: len(v) for c, v in got.items()} == dict(Counter(t[0] for t in turns))
    legal = re.compile(r"(?:<\|system\|>)?(?:<\|user\|><\|assistant\|>)+")
    for c, mine in got.items():
        mine.sort(key=lambda r: (r["turn"] is not None, r["turn"] or 0))
        text = "".join(r["rendered"] for r in mine)
        assert legal.fullmatch("".join(re.findall(r"<\|\w+\|>", text)))
        if c is not None:
            assert mine[0]["cost"] == cheapest(convs[c]) and [x for x in re.findall(r"t\d+", text)] == [f"t{n}" for n in range(len(convs[c]))]
    assert all(r["action"] == "keep" for r in got[100] + got[101]) and got[102][0]["inserted"] == ["user"]
    assert chat.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("turn", [None, 5])
def test_chat_turns_without_an_order_of_their_own(spark, turn):
    """Many turns that are null or equal are cut into chunks, to the rows that one chunk would give."""
    rng = random.Random(9)
    turns = [(c, turn, rng.choice(["system", "user", "assistant", "tool", None]), rng.choice(["same", f"t{n}"])) for n in range(300) for c in (None, 7)] + [(8, 0, "user", "a"), (8, 1, "assistant", "b")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    cut, whole = chat.repair(df, 16), chat.repair(df)
    assert {r["cost"] for r in cut.where("conv_id = 7").collect()} == {r["cost"] for r in whole.where("conv_id = 7").collect()}
    assert Counter(map(str, cut.select("conv_id", "turn", "old_role", "cost").collect())) == Counter(map(str, whole.select("conv_id", "turn", "old_role", "cost").collect()))
    base = df.withColumn("chunk", F.lit(0).cast("long")).withColumn("th", F.xxhash64("text"))
    sizes = chat._pieces(base, chat._crowded(base, 16)).where("text <> 'same'").groupBy(*chat.KEY).count()
    assert sizes.where("conv_id = 7").count() > 8 and sizes.where("conv_id = 8 and p_range is not null").count() == 0
    assert sizes.agg(F.max("count")).first()[0] < 40


# --- queries and pipeline


def test_queries_run_on_whole_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_quality", "op2_exact_dedup", "op3_byte_bpe", "op4_token_shards", "op5_simhash", "op7_substring_dedup", "op8_suffix_array", "op10_toxicity"):
        assert Q.QUERIES[name](spark, SF).select("doc_id").distinct().count() == n, name


def test_pipeline(spark, tmp_path):
    """Each stage against what it must do to the rows of the stage before."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        old, new = before.collect(), after.collect()
        if k < 4:
            assert after.columns == docs.columns
        if name == "exact dedup":
            assert sorted(r["doc_id"] for r in new) == sorted({r["text"]: r["doc_id"] for r in sorted(old, key=lambda r: -r["doc_id"])}.values())
        if name == "simhash near-dedup":
            pairs = [(r["doc_id"], r["text"]) for r in old]
            assert sorted(r["doc_id"] for r in new) == sorted(pairs[k][0] for k in kept_of(pairs))
        if name == "substring dedup":
            want = {k[0]: k[3] for k in without_shared([(r["doc_id"], r["text"]) for r in old], True)}
            assert {r["doc_id"]: hashlib.sha256(b" ".join(r["text"].encode().split())).hexdigest() for r in new} == want
        if name == "best-fit packing":
            ids = dict(zip([r["doc_id"] for r in old], ids_of([r["text"] for r in old]), strict=True))
            assert {d: sum(r["length"] for r in new if r["doc_id"] == d) for d in ids} == {d: len(x) + 1 for d, x in ids.items()}
        before = after


