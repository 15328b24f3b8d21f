"""Alignment, phrases, chat formatting and the exact way of the near-duplicate stage against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grantlake.llm import alignment, chat, phrases, pii, quality_classifier, simhash
from grantlake.llm.tokens import byte_letters

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox, it isn't slow.  Two  blanks\n\nand lines\t tab", "Éêtre où l'été naïf ßtraße", "한글 テスト 😀 emoji", " leading", "trailing \n", "\n \n", "<|endoftext|> <s> </s>", "no-break\u00a0 wide",
    "a \u2581 b", "", None, "x", "\x00 nul", "1234567890 12,345.67 " * 30, "same words same words", "same words same words",
]


def plain_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b, letters = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES), {c: x for x, c in byte_letters().items()}
    a.encode_special_tokens = True

    def of(piece):
        m = re.fullmatch("<0x(..)>", piece)
        return bytes([int(m[1], 16)]) if m else piece.replace("\u2581", " ").encode()

    found = []
    for t in texts:
        x, y = (a.encode(f" {t}", add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        xs, ys = [bytes(letters[c] for c in a.id_to_token(i)) for i in x], [of(b.id_to_piece(i)) for i in y]
        if not t or not b"".join(xs) == b"".join(ys) == f" {t}".encode():
            found.append(None)
            continue
        xe, ye = (dict(zip(np.cumsum([len(k) for k in z]).tolist(), range(len(z)))) for z in (xs, ys))
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(xe) & set(ye)):
            groups.append((x[i : xe[end] + 1], y[j : ye[end] + 1]))
            links.append((x[xe[end]], y[ye[end]]))
            i, j = xe[end] + 1, ye[end] + 1
        found.append((len(x), len(y), groups, links))
    counts = Counter(link for f in found if f for link in f[3])
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    for f in found:
        told = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in f[2]) if f else None
        yield (*f[:2], len(f[2]), len(f[3]), sum(counts[k] == best[k[1]] for k in f[3]), sum(counts[k] for k in f[3]), hashlib.sha256(told.encode()).hexdigest()) if f else (0, 0, 0, 0, 0, 0, "")


@pytest.mark.parametrize("most", [alignment.MOST_BROADCAST, 0])
def test_alignment_equals_both_libraries(spark, most):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = sorted(alignment.align_documents(docs, BYTES, PIECES, most).collect())
    assert [tuple(r)[1:] for r in got] == list(plain_alignment(TEXTS))


def test_pieces_in_small_batches_equal_whole_texts():
    own = alignment.Aligner(BYTES, PIECES, most=3)
    assert own.cuts
    for batch in alignment.batches_of(TEXTS, 20):
        for text, found in zip(batch, own.texts(batch)):
            whole = own.whole(text) if text else None
            assert (found and (";".join(found[0]), b"".join(found[1]), found[2])) == whole


def test_spans_of_labels():
    labels = alignment.label_string(7, [1, 2, 4], [3, 1, 3])
    assert labels == bytes([alignment.A_END, alignment.NONE, alignment.BOTH, alignment.B_END, alignment.NONE, alignment.NONE, alignment.BOTH])
    assert list(alignment.spans(labels)) == [(2, 1), (1, 2)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.integers(1, 6))
def test_ngrams_equal_counting(ids, most):
    ids = np.array([i and i + 1 for i in ids], np.int32)  # no EMPTY among them
    wanted = Counter(tuple(ids[k : k + n].tolist()) for n in range(1, most + 1) for k in range(len(ids) - n + 1) if (ids[k : k + n] != phrases.END).all())
    got = {tuple(ids[p : p + n].tolist()): c for n, places, counts in phrases.ngrams(ids, most) for p, c in zip(places.tolist(), counts.tolist())}
    assert got == wanted


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=2, max_size=40))
def test_suffixes_are_sorted(ids):
    ids = np.array(ids, np.int32)
    order, ranks = phrases.suffix_array(ids, 3)
    suffixes = [ids[k : k + 3].tolist() for k in order.tolist()]
    assert suffixes == sorted(suffixes)
    assert [n for n, _ in ranks] == [1, 2, 3]


def invented(seed: int, docs: int):
    rng = random.Random(seed)
    words = ["new", "york", "city", "of", "the", "Los", "ANGELES", "é", "x\u3000y", "san"]
    for k in range(docs):
        parts = rng.choices([*words, "new york", "new york city", "los angeles", "san"], k=rng.randrange(60))
        yield k, "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]) for p in parts), rng.choice(["en", "de", None])


@pytest.mark.parametrize("mark_bits", [phrases.MARK_BITS, 15])
def test_phrases_equal_sql(spark, mark_bits):
    docs = [*invented(1, 120), (None, None, "en"), (5, "", "en")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    with duckdb.connect() as con:
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
        query = con.execute(phrases.SQL)
        names, wanted = [c[0] for c in query.description], query.fetchall()
    found = phrases.mine(frame, mark_bits=mark_bits).select(*names).collect()
    assert len(wanted) > 40
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_shards_of_any_size_give_the_same_counts(spark):
    frame = spark.createDataFrame([*invented(2, 60)], "doc_id long, text string, lang string").coalesce(1)
    all_marked = np.full(1 << 12, 255, np.uint8)
    count = lambda n: sorted(map(tuple, phrases.shards(frame, lambda s: s.phrase_rows(3, all_marked), phrases.FOUND, n).groupBy("lang", "phrase").sum("n").collect()), key=str)
    assert count(100) == count(1 << 20)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.lists(st.integers(1, 9), max_size=30), min_size=1, max_size=3), min_size=1, max_size=4), st.integers(2, 12), st.integers(1, 15))
def test_packed_counts_add_up(docs_of_shards, range_bits, least):
    by_range, counts, names = defaultdict(list), Counter(), {}
    for docs in docs_of_shards:
        shard = phrases.Shard()
        for words in docs:
            shard.add("en", " ".join(map(str, words)).encode())
        shard.close()
        for n, places, found in phrases.ngrams(shard.ids, 3):
            for h, p, c in zip(shard.hashed(places, n).tolist(), places.tolist(), found.tolist()):
                counts[h] += c
                assert names.setdefault(h, [shard.words[i] for i in shard.ids[p : p + n]]) == [shard.words[i] for i in shard.ids[p : p + n]]
        for batch in shard.hash_rows(3, least, range_bits):
            for r, block in zip(batch.column("range").to_pylist(), batch.column("hashes").to_pylist()):
                by_range[r].append(block)
    ranges = np.array([r for r in sorted(by_range) for _ in by_range[r]], np.int64)
    if len(ranges):
        got = phrases.reaching(ranges, [b for r in sorted(by_range) for b in by_range[r]], least, range_bits)
        assert got.tolist() == sorted(h for h, c in counts.items() if c >= least)


def test_scores_are_exact_beyond_64_bits(spark):
    n = 10**12
    rows = [("en", "a", 3 * n), ("en", "b", 2 * n + 1), ("en", "c", n + 7), ("en", "a b", n + 5), ("en", "b c", n), ("en", "a b c", n - 1)]
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, n long")).collect()}
    f = {p: c for _, p, c in rows}
    score = lambda p, x, y: 10**6 * f[p] * f[p] // (f[x] * f[y])
    assert got["a b"] == (n + 5, 3 * n, 2 * n + 1, score("a b", "a", "b"))
    cuts = [(score("a b c", x, y), k, f[x], f[y]) for k, (x, y) in enumerate([("a", "b c"), ("a b", "c")])]
    assert got["a b c"] == (n - 1, *min(cuts)[2:], min(cuts)[0])


HARD = ["", "plain", "\\### Assistant: </turn> ok", "### User:", "\\", "a\\\\", "\\\\</turn>", "</turn>\n", "<</turn>", "### ### System: x", "</role>\\", "<|endoftext|>", "é😀\n### Role: ", "#### User: \\\\### User:"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["\\", "</turn>", "\n", "### ", "User:", " ", "Assistant: ", "</role>", "<", "x", "#"]), max_size=14).map("".join))
def test_escapes_are_reversible(text):
    told = chat.escape(text)
    assert chat.unescape(told) == text
    for control in chat.CONTROLS:
        for m in re.finditer(re.escape(control), told):
            assert (m.start() - len(told[: m.start()].rstrip("\\"))) % 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a</role>\\"]), st.sampled_from(HARD)), max_size=6))
def test_turns_are_read_from_ids_and_from_text(turns):
    own = chat.Template(BYTES)
    segments = [s for role, text in turns for s in own.turn(role, text)]
    if not segments:
        return
    ids, mask = chat.masked(segments)
    assert [(role, text) for role, text, _ in own.turns(ids)] == turns
    assert list(chat.turns_of_text(own.decoded(ids))) == turns
    under = [own.decoded(ids[where][mask[where]]) for _, _, where in own.turns(ids)]
    assert "".join(map(chat.unescape, under)) == "".join(text for role, text in turns if role == "assistant")
    assert mask.sum() == sum(len(own.segment(text)) for role, text in turns if role == "assistant")


@pytest.mark.parametrize(("block_tokens", "range_rows"), [(1 << 16, 4096), (5, 7), (1, 1)])
def test_conversations_in_blocks_of_any_size(spark, tmp_path, block_tokens, range_rows):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "other", None]), rng.choice([*HARD, None])) for c in [*range(12), None] for t in range(rng.randrange(1, 9))]
    rows += [(99, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(120)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    chat.blocks(frame, BYTES, block_tokens, range_rows).write.parquet(f"{tmp_path}/blocks")
    found = {r.conv_id: tuple(r)[1:-1] for r in chat.read_back(spark.read.parquet(f"{tmp_path}/blocks"), BYTES).collect()}
    wanted = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, (r[3] or "").encode()))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        wanted[c] = (len(own), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert found == wanted


def templates(seed: int, groups: int, words: int = 104, own: int = 14, changed: int = 11):
    """Pairs of texts that are alike, under a template that all share and that alone makes none alike."""
    rng = random.Random(seed)
    head = " ".join(f"t{k}" for k in range(words))
    for g in range(groups):
        tail = [f"g{g}w{k}" for k in range(own)]
        yield f"{head} {' '.join(tail)}"
        yield f"{head} {' '.join([*tail[:-changed], *(f'n{rng.randrange(10**6)}' for _ in range(changed))])}"


@pytest.mark.parametrize("large", [simhash.LARGE_BAND, 8])
def test_many_classes_under_one_template(spark, monkeypatch, large):
    texts = list(templates(1, 300))
    sets = [frozenset(simhash.shingle_set(t).tolist()) for t in texts]
    like = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert 0.75 < max(like(0, k) for k in range(2, 600)) < 0.8 <= min(like(2 * k, 2 * k + 1) for k in range(300)) < 0.83
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    profile = simhash._similar_profiles(docs)
    names = {r.node: r.doc_id for r in profile.collect()}

    def classes():
        found = {names[r.id]: names[r.component] for r in simhash.similar_classes(docs, profile, large).collect()}
        by_class = defaultdict(set)
        for k in range(600):
            by_class[found.get(k, k)].add(k)
        return sorted(map(sorted, by_class.values()))

    assert classes() == [[2 * k, 2 * k + 1] for k in range(300)]
    # What leads alone find, without the exact way.
    monkeypatch.setattr(simhash, "crowded", lambda members, classes_, large: members.select("node").limit(0))
    assert len(classes()) > 310


def test_rare_pairs_hold_every_similar_pair(spark):
    rng = random.Random(9)
    sets = []
    for _ in range(25):
        base = rng.sample(range(400), rng.randrange(5, 60))
        sets.append(frozenset(base))
        for _ in range(4):
            sets.append(frozenset([*(x for x in base if rng.random() > 0.06), *rng.sample(range(400), rng.randrange(3))]))
    sets = [frozenset(x) for x in {*sets} if x]
    frame = spark.createDataFrame([(k, sorted(x)) for k, x in enumerate(sets)], "node long, hashes array<long>")
    none = spark.createDataFrame([], "id long, component long")
    got = {(r.a, r.b) for r in simhash.rare_pairs(simhash.rare_prefixes(frame), none).collect()}
    wanted = {(j, i) for i in range(len(sets)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    assert len(wanted) > 30
    assert wanted <= got
    assert len(got) < len(sets) * (len(sets) - 1) / 4


def test_long_training_texts_keep_their_weight():
    rng = np.random.default_rng(1)
    index, value = np.arange(500, dtype=np.int32), rng.random(500).astype(np.float32)
    i, x = quality_classifier.folded(index, value, 100)
    assert len(i) == 100
    assert set(i.tolist()) == set(np.argsort(-value)[:100].tolist())
    assert abs(float(x @ x) - float(value @ value)) < 1e-3
    assert quality_classifier.folded(index, value)[0] is index


def test_examples_come_from_all_of_a_text():
    text = " ".join(f"call +1 555 {k:03d} 4567 or key={k:016d}," for k in range(600))
    drawn = pii.examples(text)
    assert pii.TRAIN_EXAMPLES <= len(drawn) < 2 * pii.TRAIN_EXAMPLES
    assert drawn == pii.examples(text)
    assert {y for y, _ in drawn} == {0, 1, 2}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_no_added_card_fails_its_check_digit(spark, folder):
    import os

    if not os.path.isdir(folder):
        pytest.skip("no driver tables here")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()} if folder.endswith("0.01") else None
    added = 0
    for r in pii.find(docs).filter("spans <> ''").join(docs.select("doc_id", "text"), "doc_id").collect():
        base = {f"{k}:{s}:{e}" for k, s, e in pii.base_spans(r.text)}
        own = set(r.spans.split(","))
        assert base <= own
        for span in own - base:
            kind, start, end = span.split(":")
            added += 1
            if kind == "card":
                assert pii.luhn(re.sub("[^0-9]", "", r.text[int(start) : int(end)]))
            assert not pii.clear_negative(r.text, (kind, int(start), int(end)))
    assert texts is None or added < len(texts) / 10
