"""Language ID, decontamination, tokenizers, token files, chat and quality, with their edge cases."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm import chat_format as chat
from millrace.llm.byte_bpe import ByteBpe
from millrace.llm.decontaminate import build_index, drop_contaminated, find_contamination, find_items, question_and_answer
from millrace.llm.hashmap import HashMap64
from millrace.llm.language_id import automaton, drop_undetermined, identify_languages
from millrace.llm.pretokens import PretokenTable, pretokens, split_texts
from millrace.llm.quality import fit_ordinal, score_quality
from millrace.llm.sentencepiece_codec import Codec, decode_pieces, encode_pieces, encoding_digest
from millrace.llm.token_counts import count_texts, count_tokens
from millrace.llm.token_files import read_document, read_token_files, write_token_files

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", "  hi ", "a▁b", "日本語 テキスト 𝕏", "\n\n a\n", "x" * 3000, "ab" * 1500, " " * 400, "the" * 50, "<s></s><0x0A>", "ﬁ½²é",
    "don't we'll 're' ''s \n's", "a<|endoftext|>b  <|endoftext|>", "\t　x y", "internationalization " * 40
]


def odd_texts(n=300, seed=5):
    rng = random.Random(seed)
    letters = "abcdestrvelm'  \n\t½²é日!.,-_'0123▁"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, Letter int")


# language

def test_automaton_knows_every_substring():
    text = [0, 1, 0, 0, 1, 1, 0, 2, 0, 1]
    table = automaton(text, 3)

    def known(word):
        state = 0
        for c in word:
            state = table[state, c]
            if state < 0:
                return False
        return True

    inside = {tuple(text[i:j]) for i in range(10) for j in range(i, 11)}
    rng = random.Random(0)
    for _ in range(500):
        word = tuple(rng.randrange(3) for _ in range(rng.randint(0, 6)))
        assert known(word) == (word in inside)


def test_phrases_equal_a_plain_parse(spark):
    from millrace.llm.language_id import LANE, _one, build_model, squeeze

    rng = random.Random(2)
    texts = {k: ["".join(rng.choice(k) for _ in range(300)) for _ in range(8)] for k in ("abcde ", "cdefg ")}
    model = build_model(texts)
    sample = "".join(rng.choice("abcdefgh ") for _ in range(LANE + 100))
    symbols, bounds = squeeze(*_one(sample))
    found = model.phrases(symbols, bounds)[0]
    for k, name in enumerate(model.languages):
        rest = [squeeze(*_one(t))[0] for i, t in enumerate(texts[name]) if i % 4 != 3]
        reference = bytes(np.concatenate([np.concatenate((r, [0])) for r in rest]).astype(np.uint8).tolist())
        count = 0
        for lane in range(0, len(symbols), LANE):
            part, at = bytes(symbols[lane : lane + LANE].tolist()), 0
            phrases = 0
            while at < len(part):
                size = 1
                while at + size < len(part) and part[at : at + size + 1] in reference:
                    size += 1
                at += size
                phrases += 1
            count += phrases
        assert int(found[k]) == count


def test_languages_are_told_apart(spark):
    rng = random.Random(1)
    vocabulary = {"xx": ["alba", "torno", "quessa", "mila"], "yy": ["grund", "schacht", "weber", "tzung"]}
    text = lambda k: " ".join(rng.choice(vocabulary[k]) for _ in range(40))
    rows = [(i, text(k), k, 0) for i, k in enumerate(["xx", "yy"] * 40)]
    more = [
        (900, None, "xx", 0), (901, "", None, 0), (902, "12 34 !!", "xx", 0), (903, text("yy") * 300, "xx", 0), (904, "alba", None, 0),
        (904, "alba", None, 0)
    ]
    docs = frame(spark, rows + more)
    out = identify_languages(docs, frame(spark, rows)).collect()
    assert len(out) == len(rows) + len(more)
    for r in out:
        assert 0 <= r.score <= 1
        assert r.lang_pred == ("und" if r.doc_id in (900, 901, 902) else "yy" if r.doc_id == 903 else "xx" if r.doc_id == 904 else r.lang)
    assert drop_undetermined(docs).count() == len(rows) + 3
    assert identify_languages(frame(spark, []), frame(spark, rows)).count() == 0
    assert {r.lang_pred for r in identify_languages(docs, frame(spark, [])).collect()} == {"und"}


def test_languages_are_learnt_past_a_common_opening(spark):
    rng = random.Random(15)
    vocabulary = {"xx": ["alba", "torno", "quessa", "mila"], "yy": ["grund", "schacht", "weber", "tzung"]}
    text = lambda k, n: " ".join(rng.choice(vocabulary[k]) for _ in range(n))
    opening = " ".join("".join(rng.choice("jkpxy") for _ in range(6)) for _ in range(320))  # over 2,048 characters
    labelled = [(i, f"{opening} {text(k, 1500)}", k, 0) for i, k in enumerate(["xx", "yy"] * 30)]
    rows = [(i, text(k, 40), k, 0) for i, k in enumerate(["xx", "yy"] * 20)]
    out = identify_languages(frame(spark, rows), frame(spark, labelled)).collect()
    assert all(r.lang_pred == r.lang and r.score > 0.1 for r in out)


def test_a_language_with_one_long_text_is_learnt_from_all_of_it(spark):
    rng = random.Random(16)
    vocabulary = {"xx": ["alba", "torno", "quessa", "mila"], "yy": ["grund", "schacht", "weber", "tzung"]}
    text = lambda k, n: " ".join(rng.choice(vocabulary[k]) for _ in range(n))
    opening = " ".join("".join(rng.choice("jkpxy") for _ in range(6)) for _ in range(8_000))
    labelled = [(0, f"{opening} {text('xx', 26_000)}", "xx", 0), *((i, text("yy", 300), "yy", 0) for i in range(1, 20))]
    assert len(labelled[0][1]) > 200_000
    rows = [(i, text(k, 40), k, 0) for i, k in enumerate(["xx", "yy"] * 20)]
    out = identify_languages(frame(spark, rows), frame(spark, labelled)).collect()
    assert all(r.lang_pred == r.lang for r in out)


def test_two_hundred_languages(spark):
    rng = random.Random(17)
    words = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(25)] for k in range(200)}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    labelled = [(i, text(k, 700), k, 0) for i, k in enumerate([*words] * 3)]
    rows = [(i, text(k, 30), k, 0) for i, k in enumerate(words)]
    out = identify_languages(frame(spark, rows), frame(spark, labelled)).collect()
    assert len(out) == 200 and sum(r.lang_pred == r.lang for r in out) >= 198


def test_documents_stay_where_no_language_is_learnt(spark):
    rows = [(0, "alba torno", None, 0), (1, "日本", None, 0), (1, None, None, 0), (2, "", None, 0), (3, "12 34 !!", None, 0), (None, "mila", None, 0)]
    assert sorted(r.text for r in drop_undetermined(frame(spark, rows)).collect()) == ["alba torno", "mila", "日本"]
    few = [(i, "alba torno", "xx", 0) for i in range(20) if zlib.crc32(str(i).encode()) % 3 == 1]  # labels of held-out rows only
    assert few and drop_undetermined(frame(spark, few)).count() == len(few)


def test_texts_of_no_learnt_language_go(spark):
    rng = random.Random(31)
    vocabulary = {"xx": ["alba", "torno", "quessa", "mila"], "yy": ["grund", "schacht", "weber", "tzung"]}
    text = lambda k: " ".join(rng.choice(vocabulary[k]) for _ in range(40))
    rows = [(i, text(k), k, 0) for i, k in enumerate(["xx", "yy"] * 40)]
    noise = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(8)) for _ in range(60))
    docs = frame(spark, rows + [(900, noise, None, 0), (None, "съешь ещё этих мягких булок " * 20, None, 0), (901, "zq xk", None, 0), (901, noise, None, 1)])
    out = identify_languages(docs, frame(spark, rows)).collect()
    assert [r.doc_id for r in out if not r.fits] == [900, None, 901]
    assert {(r.doc_id, r.Letter) for r in drop_undetermined(docs).collect()} == {*((i, 0) for i in range(80)), (901, 0)}


def test_languages_clashing_names(spark):
    rows = [(i, "alba torno" if i % 2 else "grund weber", "xx" if i % 2 else "yy", 0) for i in range(40)]
    docs = frame(spark, rows).toDF("doc_id", "text", "lang", "fits")
    assert drop_undetermined(docs).columns == docs.columns and drop_undetermined(docs).count() == 40
    assert identify_languages(docs, docs).columns == [*docs.columns, "lang_pred", "score", "_fits"]


# decontamination

def sentence(rng, n, vocabulary):
    return " ".join(f"{rng.choice('bcdfg')}{rng.randrange(vocabulary)}" for _ in range(n))


def scores_of_all(index, sets):
    """(set, segment): score of every segment for every set of term numbers, by all its words."""
    out = {}
    for k, terms in enumerate(sets):
        for s in range(len(index.rest)):
            own = slice(index.own_start[s], index.own_start[s + 1])
            out[k, s] = float(index.own_weight[own][np.isin(index.own_term[own], terms)].sum())
    return out


def pairs_of(index, sets):
    return np.array([k * len(index.terms) + t for k, terms in enumerate(sets) for t in sorted(terms)], dtype=np.int64)


@pytest.mark.parametrize("block", [1, 4, 16])
def test_search_is_exact(monkeypatch, block):
    from millrace.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BLOCK", block)
    monkeypatch.setattr(decontaminate, "CELLS", 100)
    rng = random.Random(3)
    items = [(i, sentence(rng, rng.randint(8, 30), 60), sentence(rng, rng.randint(3, 12), 60)) for i in range(120)]
    index = build_index(items, threshold=0.15)
    sets = [rng.sample(range(len(index.terms)), rng.choice([1, 20, 50])) for _ in range(60)] + [[]]
    scores = scores_of_all(index, sets)
    for threshold in (0.15, 0.3, 0.6):
        own, segment, score, _ = index.search(pairs_of(index, sets), threshold)
        assert {(k, s) for k, s in zip(own.tolist(), segment.tolist())} == {ks for ks, v in scores.items() if v >= threshold}
        assert all(abs(scores[k, s] - v) < 1e-5 for k, s, v in zip(own.tolist(), segment.tolist(), score.tolist()))
    assert index.search(np.zeros(0, np.int64), 0.3)[3] == 0 and find_items(build_index([]), np.zeros(3, np.uint64), np.array([0, 3]), 0.6, 0.6) == []


def test_few_postings_are_scored():
    rng = random.Random(8)
    items = [(i, sentence(rng, 30, 3000), sentence(rng, 10, 3000)) for i in range(3000)]
    index = build_index(items)
    lists = np.bincount(index.own_term, minlength=len(index.terms))
    sets = [rng.sample(range(len(index.terms)), 100) for _ in range(200)]
    _, _, _, scored = index.search(pairs_of(index, sets), 0.6)
    assert scored < sum(int(lists[t]) for terms in sets for t in terms) / 10


def test_planted_items_are_found(spark):
    rng = random.Random(4)
    items = [(i, f"{sentence(rng, 20, 5000)}. {sentence(rng, 8, 5000)}.") for i in range(30)] + [(30, None), (31, ""), (32, sentence(rng, 300, 5000) + ".")]
    text = lambda n: sentence(rng, n, 5000)
    rows, truth = [], {}
    for i in range(60):
        body = text(rng.choice([10, 100, 1000]))
        if i % 3 == 0:
            own = items[i // 3]
            body = f"{body} {own[1].upper() if i % 2 else own[1]} {text(50)}"
            truth[i] = [own[0]]
        rows.append((i, body, None, 0))
    question = items[2][1].split(". ")[0]
    rows += [(100, None, None, 0), (101, "", None, 0), (102, text(40_000) + " " + items[32][1], None, 0), (103, question, None, 0)]
    truth[102] = [32]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {r.doc_id: r for r in find_contamination(frame(spark, rows), bench).collect()}
    assert len(out) == len(rows)
    assert {i: r.item_ids for i, r in out.items() if r.contaminated} == truth
    assert {r.doc_id for r in drop_contaminated(frame(spark, rows), bench).collect()} == set(out) - set(truth)
    assert find_contamination(frame(spark, []), bench).count() == 0
    assert find_contamination(frame(spark, rows), bench.limit(0)).where("contaminated").count() == 0


def test_shards_of_the_index_give_the_same(spark, monkeypatch):
    from millrace.llm import decontaminate

    rng = random.Random(6)
    items = [(i, f"{sentence(rng, 20, 5000)}. {sentence(rng, 8, 5000)}.") for i in range(40)]
    rows = [(i, sentence(rng, 60, 5000) + " " + items[i][1] + " " + items[(i * 7) % 40][1], None, 0) for i in range(30)]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), frame(spark, rows)
    one = sorted((r.doc_id, r.item_ids) for r in find_contamination(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 3_000)
    assert sorted((r.doc_id, r.item_ids) for r in find_contamination(docs, bench).collect()) == one
    assert all(i in found for i, found in one)


@pytest.mark.parametrize("shard_bytes", [10**6, 900])
def test_rows_are_judged_whatever_their_id(spark, monkeypatch, shard_bytes):
    from millrace.llm import decontaminate

    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard_bytes)
    rng = random.Random(14)
    items = [(i, f"{sentence(rng, 20, 5000)}. {sentence(rng, 8, 5000)}.") for i in range(12)]
    clean = [sentence(rng, 40, 5000) for _ in range(3)]
    rows = [
        (None, items[0][1], None, 0), (None, clean[0], None, 1), (7, items[1][1], None, 2), (7, clean[1], None, 3),
        (7, f"{items[2][1]} {items[3][1]}", None, 4), (8, clean[2], None, 5)
    ]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    out = sorted(((r.doc_id, r.item_ids) for r in find_contamination(docs, bench).collect()), key=str)
    assert out == sorted([(None, [0]), (None, []), (7, [1]), (7, []), (7, [2, 3]), (8, [])], key=str)
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.Letter for r in kept.collect()) == [1, 3, 5]


def test_items_with_a_changed_word_are_found(spark):
    rng = random.Random(12)
    items = [(i, f"{sentence(rng, rng.choice([3, 8, 20]), 5000)}. {sentence(rng, rng.choice([5, 8]), 5000)}.") for i in range(12)]
    rows, truth = [], {}
    for i, item in items:
        own = item.split()
        for k in range(len(own)):
            truth[len(rows)] = [i]
            rows.append((len(rows), " ".join([sentence(rng, 30, 5000), *own[:k], "other", *own[k + 1 :], sentence(rng, 30, 5000)]), None, 0))
    # the words of an answer out of order are not the answer
    question, answer = items[2][1].split(". ")
    rows.append((len(rows), f"{question} {' '.join(reversed(answer[:-1].split()))}", None, 0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = find_contamination(frame(spark, rows), bench).collect()
    assert {r.doc_id: r.item_ids for r in out if r.contaminated} == truth


def test_question_and_answer_may_stand_far_apart(spark):
    rng = random.Random(13)
    items = [(i, f"{sentence(rng, 8 + 3 * i, 5000)}. {sentence(rng, 20 - i, 5000)}.") for i in range(8)]
    rows, truth = [], {}
    for i, item in items:
        question, answer = item.split(". ")
        for apart in (50, 150, 3000):
            for one, other in ((question, answer), (answer, question)):
                truth[len(rows)] = [i]
                rows.append((len(rows), " ".join([sentence(rng, 70, 5000), one, sentence(rng, apart, 5000), other, sentence(rng, 70, 5000)]), None, 0))
        rows += [(1000 + i, question, None, 0), (2000 + i, answer, None, 0)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = find_contamination(frame(spark, rows), bench).collect()
    assert {r.doc_id: r.item_ids for r in out if r.contaminated} == truth


def test_items_in_other_scripts_and_marks_are_found(spark):
    items = [(0, "The “quick” brown fox — jumps over… the lazy dog. It lands upon the soft green grass."), (1, "東京は日本の首都であり人口が最も多い。富士山は日本で一番高い山として知られる。")]
    rows = [
        (0, "Say: the 'quick' brown fox - jumps over... the lazy dog. It\u00a0lands upon the soft green grass!", None, 0),
        (1, "前置きの文章。東京は日本の首都であり人口が最も多い、富士山は日本で一番高い山として知られる、と本に書いてある。", None, 0), (2, "大阪は西日本の中心であり商業が盛んな町として知られる。", None, 0)
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = find_contamination(frame(spark, rows), bench).collect()
    assert {r.doc_id: r.item_ids for r in out if r.contaminated} == {0: [0], 1: [1]}


def test_findings_equal_brute_force(spark):
    """Retrieval and verification against every segment of every item for every window of every text."""
    from millrace.llm import decontaminate as d

    rng = random.Random(41)
    items = [(i, f"{sentence(rng, rng.choice([4, 12, 90]), 300)}. {sentence(rng, rng.choice([5, 9, 70]), 300)}.") for i in range(40)]
    rows = []
    for i in range(80):
        own = items[rng.randrange(40)][1].split()
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = f"b{rng.randrange(300)}"
        rows.append((i, " ".join([sentence(rng, rng.choice([5, 200]), 300), *own, sentence(rng, 90, 300)]), None, 0))
    words_of = lambda t: regex.findall(r"[a-z0-9]+", t.lower())
    parts = {i: [words_of(p) for p in question_and_answer(t)] for i, t in items}
    segments = []  # (item, counts)
    for i, (q, a) in parts.items():
        for own in [q + a, max(q, a, key=len)] if len(max(q, a, key=len)) < len(q + a) else [q + a]:
            n = max(1, -(-len(own) // d.SEGMENT))
            sizes = [len(own) // n + (k < len(own) % n) for k in range(n)]
            for k in range(n):
                part = own[sum(sizes[:k]) : sum(sizes[: k + 1])]
                segments.append((i, {w: part.count(w) for w in part}))
    mean, df = sum(sum(c.values()) for _, c in segments) / len(segments), {}
    for _, c in segments:
        for w in c:
            df[w] = df.get(w, 0) + 1

    def weight(c):
        size = sum(c.values())
        own = {w: np.log1p((len(segments) - df[w] + 0.5) / (df[w] + 0.5)) * f * (d.K1 + 1) / (f + d.K1 * (1 - d.B + d.B * size / mean)) for w, f in c.items()}
        return {w: x / sum(own.values()) for w, x in own.items()}

    weighed = [(i, weight(c)) for i, c in segments]

    def holds(part, text):
        n = min(5, len(part))
        if not n:
            return True
        grams, have = ({tuple(x[k : k + n]) for k in range(len(x) - n + 1)} for x in (part, text))
        if len(grams & have) / len(grams) >= d.OVERLAP:
            return True
        before = [0] * (len(text) + 1)
        for k, w in enumerate(part):
            row = [k + 1]
            for j, x in enumerate(text):
                row.append(min(before[j] + (x != w), before[j + 1] + 1, row[j] + 1))
            before = row
        return 1 - min(before) / len(part) >= d.IN_ORDER - 1e-9

    truth = {}
    for i, t, _, _ in rows:
        own = words_of(t)
        windows = [set(own[k : k + d.PASSAGE]) for k in range(0, max(1, len(own) - d.PASSAGE + d.STRIDE), d.STRIDE)]
        near = {item for item, c in weighed if any(sum(x for w, x in c.items() if w in win) >= d.THRESHOLD for win in windows)}
        truth[i] = sorted(item for item in near if all(holds(p, own) for p in parts[item]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows).toDF("doc_id", "text", "item_ids", "q")
    assert {r.doc_id: r.item_ids for r in find_contamination(docs, bench).collect()} == truth
    assert sum(map(bool, truth.values())) > 20
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, own in truth.items() if not own}


def test_question_and_answer():
    assert question_and_answer("One two three four five six. Seven eight nine ten eleven.") == ("One two three four five six.", "Seven eight nine ten eleven.")
    assert question_and_answer("a b c d")[1] == "c d"


# SentencePiece

def test_codec_equals_the_library():
    codec, library = Codec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = odd_texts()
    for text, ids in zip(texts, codec.encode_all(texts)):
        assert ids.tolist() == library.encode(text) == codec.encode(text).tolist()
        assert codec.decode(ids) == library.decode(ids.tolist())


def test_window_is_bounded_and_gives_the_same():
    codec = Codec(PIECES)
    codec.stretches = None  # whole texts through one lattice
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in ["the quick brown fox " * 60, "internationalization" * 80, "x" * 500, "日本é\n" * 100]:
        assert codec.encode(text).tolist() == library.encode(text)


def test_no_lattice_is_wider_than_its_window():
    from millrace.llm.sentencepiece_codec import WINDOW

    codec, library = Codec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [*odd_texts(50), "a" * 900, "internationalization" * 45, "日本é" * 300, "x" * 5000, "ab" * 3000]
    assert [x.tolist() for x in codec.encode_all(texts)] == [library.encode(t) for t in texts]
    assert 0 < codec.window <= WINDOW * codec.longest


def test_unigram_models_take_the_best_path():
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.trainer_spec.model_type = 1
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)]:
        model.pieces.add(piece=piece, score=score, type=kind)
    rng = random.Random(8)
    made = {"▁", "a", "b", "c"}
    while len(made) < 60:
        made.add(("▁" if rng.random() < 0.3 else "") + "".join(rng.choice("abc") for _ in range(rng.randint(1, 5))))
    for piece in sorted(made):
        model.pieces.add(piece=piece, score=-rng.uniform(1, 9) - len(piece) * 0.1, type=1)
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString()), Codec(proto=model.SerializeToString())
    for _ in range(200):
        text = "".join(rng.choice("aabbcc x") for _ in range(rng.randint(0, 70)))
        assert codec.encode(text).tolist() == library.encode(text)


def test_pieces_on_frames(spark):
    rows = [(i, t, None, 0) for i, t in enumerate([None, "", "Hello there", "Hello there", "é\n" * 40_000])]
    out = {r.doc_id: r for r in decode_pieces(encode_pieces(frame(spark, rows), PIECES, with_text=True), PIECES).collect()}
    for i, t, _, _ in rows:
        assert out[i].decoded == out[i]._decoded == (t or "")
    rows += [(None, "no id", None, 0)]
    out = encoding_digest(frame(spark, rows).toDF("doc_id", "text", "id", "same"), PIECES).collect()
    assert len(out) == 6 and all(r.round_trip for r in out) and [r.doc_id for r in out].count(None) == 1
    assert encode_pieces(frame(spark, []), PIECES).count() == 0


# byte-level BPE

def test_pretokens_equal_the_pattern():
    pattern, texts = regex.compile(public_tokenizers.PATTERN), odd_texts(1500)
    for row, n, points, offsets, owner, marks, text in split_texts(texts, []):
        starts, ends, _, segment = pretokens(points, offsets, marks)
        found = [[] for _ in range(n)]
        for s, e, g in zip(starts.tolist(), ends.tolist(), segment.tolist()):
            found[owner[g]].append(text[s:e])
        assert found == [pattern.findall(t) for t in texts[row : row + n]]


def test_counts_and_merges_equal_the_library():
    library, texts = Tokenizer.from_file(BPE), odd_texts()
    with open(BPE, "rb") as f:
        source = f.read()
    truth = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert count_texts(source, texts).tolist() == [len(x) for x in truth]
    words = ["hello", " world", "ß", "aaaaaaa", " " * 30, "日本語"]
    assert [x.tolist() for x in ByteBpe(source).merge(words)] == [library.encode(w, add_special_tokens=False).ids for w in words]


def thue_morse(n, one, other):
    return "".join(one if bin(k).count("1") % 2 == 0 else other for k in range(n))


@pytest.mark.parametrize("modulus", [None, 40])
def test_words_of_equal_hash_are_told_apart(monkeypatch, modulus):
    from millrace.llm import pretokens as p
    from millrace.llm import token_counts, token_files

    library = Tokenizer.from_file(BPE)
    with open(BPE, "rb") as f:
        source = f.read()
    texts = [thue_morse(n, *pair) for n in (1024, 4096) for pair in ("eq", "qe", "ae", "ea")] + odd_texts(60)
    if modulus:  # many pre-tokens for each hash
        real = p.span_hashes
        monkeypatch.setattr(p, "span_hashes", lambda *a: real(*a) % np.uint64(modulus))
    token_counts._tables.clear()
    token_files._tables.clear()
    truth = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert count_texts(source, texts).tolist() == [len(x) for x in truth]
    assert [x.tolist() for x in token_files.encode_texts(source, texts)] == truth
    token_counts._tables.clear()
    token_files._tables.clear()


def test_long_words_merge_in_few_rounds():
    rng = random.Random(2)
    bpe, library = ByteBpe(open(BPE, "rb").read()), Tokenizer.from_file(BPE)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters, n in (
        ("abcdefghijklmnopqrstuvwxyz", 1_000_000), ("etaoin", 60_000), ("é日x", 5_000), ("ab", 30_000), ("AbC+/09xyz", 50_000))]
    start = time.perf_counter()
    found = bpe.merge([*texts, "", "a", "the"])
    took = time.perf_counter() - start
    assert [x.tolist() for x in found] == [library.encode(t, add_special_tokens=False).ids for t in [*texts, "", "a", "the"]]
    assert bpe.merge([]) == [] and took < 30  # about 1.5 s; minutes if each round looked at all symbols


def test_tables_are_bounded_by_code_points():
    bpe = ByteBpe(open(BPE, "rb").read())
    table = PretokenTable(lambda texts: bpe.merge(texts), most_points=300_000)
    rng, held = random.Random(3), 0
    for _ in range(40):
        words = ["".join(rng.choice("abcdefgh") for _ in range(2_000)) for _ in range(25)]
        text = "".join(words)
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        starts, ends, hashes, _ = pretokens(points, np.arange(0, len(text) + 1, 2_000), np.full(25, -1))
        ids, bounds = table.lists(table.numbers(points, text, starts, ends, hashes))
        held = max(held, len(table.points))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [x.tolist() for x in bpe.merge(words)]
    assert table.points_used <= 300_000 and held <= 1 << 19


def test_hashes_differ_where_one_polynomial_would_not():
    from millrace.llm.textkit import span_hashes

    raw = np.frombuffer((thue_morse(4096, "a", "b") + thue_morse(4096, "b", "a")).encode(), dtype=np.uint8)
    one, other = span_hashes(raw, np.array([0, 4096]), np.array([4096, 8192]))
    assert one != other


def test_counts_on_frames(spark):
    rows = [(1, None, None, 0), (2, "", None, 0), (3, "word " * 600, None, 0), (3, "é", None, 0), (4, "x" * 100_000, None, 0)]
    out = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(frame(spark, rows), BPE).collect())
    library = Tokenizer.from_file(BPE)
    sizes = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t, _, _ in rows]
    assert out == sorted((i, len((t or "").encode()), n, n > 512) for (i, t, _, _), n in zip(rows, sizes))
    assert count_tokens(frame(spark, []), BPE).count() == 0


def test_hash_map():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    own = HashMap64(4)
    for part in np.array_split(keys, 7):
        own.insert(part, (part % np.uint64(1000)).astype(np.int32))
    assert (own.find(keys) == (keys % np.uint64(1000)).astype(np.int32)).all()
    assert (own.find(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)) == -1).all()


def test_token_files_round_trip(spark, tmp_path):
    rng = random.Random(0)
    texts = [None, "", *odd_texts(150), "long text " * 20_000]
    rows = [(i, t, None, 0) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    path = f"file://{tmp_path}/files"
    write_token_files(frame(spark, rows), path, BPE)
    library, start = Tokenizer.from_file(BPE), 0
    out = {r.doc_id: r for r in read_token_files(spark, path, ids=True).collect()}
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        r = out[i]
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), ids)
        start += len(ids)
    assert read_document(spark, path, 5)[0].tolist() == out[5].ids
    assert read_document(spark, path, 10**6) == []
    odd = [(None, "a b", None, 0), (None, None, None, 0), (-(1 << 63), "least", None, 0), (7, "one", None, 0), (7, "two words", None, 0)]
    write_token_files(frame(spark, odd).toDF("doc_id", "text", "id", "n"), f"{path}-odd", BPE)
    out = read_token_files(spark, f"{path}-odd").orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, None, -(1 << 63), 7, 7]
    assert [len(x) for x in read_document(spark, f"{path}-odd", -(1 << 63))] == [len(library.encode("least", add_special_tokens=False).ids) + 1]
    assert len(read_document(spark, f"{path}-odd", 7)) == 2
    write_token_files(frame(spark, []), f"{path}-none", BPE)
    assert read_token_files(spark, f"{path}-none").count() == 0


# chat

TRICKY = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x", "plain", "", "a\nb\\n", "<|<|", "\\", "é" * 50]


def test_escapes_are_reversible():
    for t in TRICKY:
        assert chat.unescape(chat.escape(t)) == t and chat.unescape_role(chat.escape_role(t)) == t
        assert chat.START not in chat.escape(t) and "\n" not in chat.escape_role(t)


def chat_rows(seed=2):
    rng = random.Random(seed)
    rows = []
    for c in range(25):
        for t in range(rng.randint(1, 40)):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "assistant", "tool\nx"])
            rows.append((c, t, role, rng.choice([*TRICKY, None, "word " * rng.randint(1, 90)])))
    rows += [
        (90, 0, "assistant", "over " * 5000), (91, 0, "system", "only"), (92, None, None, None), (None, 1, "user", "x"),
        (93, 0, "user", "same"), (93, 0, "user", "same")
    ]
    return rows


def test_chat_clashing_names_and_no_windows(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "a", 5, "w"), (1, 1, "assistant", None, 6, "v")],
        "conv_id long, turn long, role string, text string, tokens int, window string"
    )
    windows = chat.format_conversations(turns, BPE)
    out = chat.read_windows(windows).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in out] == [(1, 2, 0)]
    assert chat.read_windows(windows.limit(0)).count() == 0


def test_chat_windows(spark):
    rows = chat_rows()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_conversations(turns, BPE, budget=200, history=60)
    out = {r.conv_id: r for r in chat.read_windows(windows).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(out) == set(by)
    for c, own in by.items():
        own.sort()
        said = "".join(t for _, r, t in own if r == "assistant")
        r = out[c]
        assert (r.n_turns, r.loss_chars) == (len(own), len(said))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    for w in windows.collect():
        turns_in = chat.parse_window(w.text)
        assert len(turns_in) == w.turns
        first_role = by[w.conv_id][0][1]
        fixed = 1 if first_role == "system" else 0
        assert w.tokens <= 200 or w.turns - fixed - (w.repeated - fixed if w.window and fixed else w.repeated) <= 1
        if first_role == "system":
            assert turns_in[0][0] == "system"
    assert any(w.repeated > 1 for w in windows.collect())
    assert chat.read_windows(chat.format_conversations(turns.limit(0), BPE)).count() == 0


# quality

def test_quality_orders_grades(spark):
    rng = random.Random(0)
    good, bad, vile = [f"g{i}" for i in range(30)], [f"b{i}" for i in range(30)], [f"v{i}" for i in range(6)]
    rows, grades = [], []
    for i in range(900):
        grade = i % 3
        own = [rng.choice(good) for _ in range(20)]
        if grade == 1:
            own[:10] = [rng.choice(bad) for _ in range(10)]
        if grade == 0:
            own[:3] = [rng.choice(vile) for _ in range(3)]
        rng.shuffle(own)
        rows.append((i, " ".join(own), None, 0))
        grades.append((i, grade))
    docs = frame(spark, rows + [(5000, None, None, 0), (5001, "", None, 0), (5002, "g1 " * 50_000, None, 0)])
    rated = frame(spark, rows[:600]).join(spark.createDataFrame(grades, "doc_id long, grade int"), "doc_id")
    out = {r.doc_id: r for r in score_quality(docs, rated).collect()}
    assert len(out) == 903
    held = [(out[i].expected_grade, out[i].kept, g) for i, g in grades[600:]]
    mean = [np.mean([e for e, _, g in held if g == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert np.mean([k == (g == 2) for _, k, g in held]) > 0.95
    assert all(1 >= r.tails[0] >= r.tails[1] >= 0 for r in out.values())
    assert score_quality(frame(spark, []), rated).count() == 0
    assert all(r.kept for r in score_quality(docs, rated.limit(0)).collect())


def test_quality_equals_plain_python(spark):
    """Scores from the fitted weights, and the fit against a plain likelihood."""
    from millrace.llm import quality as q
    from millrace.llm.textkit import mix, span_hashes

    rng = random.Random(5)
    texts = [
        "", "One two, two THREE!!", "a-b c' c' c'", "É é x", "solo " * 400,
        *(" ".join(rng.choice(["good", "bad,", "Fine!", "UGLY"]) for _ in range(rng.randint(1, 30))) for _ in range(60))
    ]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(0, None, "again")], "doc_id long, text string, kept string")
    ratings = spark.createDataFrame(
        [(i, 2 if "good" in t else 1 if "Fine" in t else 0) for i, t in enumerate(texts)] + [(9999, 1), (None, 2), (3, None)],
        "doc_id long, grade int"
    )
    model = q.learn_quality(docs, ratings, "doc_id", "text", "grade")

    def hashed(word):
        raw = np.frombuffer(word.encode(), dtype=np.uint8)
        return span_hashes(raw, np.array([0]), np.array([len(raw)]))

    def level(part, whole):
        return np.uint64(min(9, max(0, int(np.floor(np.log2(max(part / max(whole, 1), 1e-9))) + 9))))

    def numbers(text):
        low = "".join(c.lower() if c.isascii() else c for c in text)
        own, marks = regex.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", low), regex.findall(r"[!-/:-@\[-`{-~]+", text)
        found = [hashed(w)[0] for w in set(own)]
        found += [mix(hashed(m) ^ np.uint64(0xA5A5A5A5) ^ (level(marks.count(m), len(own)) << np.uint64(56)))[0] for m in set(marks)]
        size = len(text.encode())
        for salt, value in ((1, level(len(own) - len(set(own)), len(own))), (2, level(sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text), size))):
            found.append(mix(np.array([value + np.uint64(salt << 40)]))[0])
        return {int(h) >> (64 - q.WEIGHT_BITS) for h in found}

    def tails(text, weights, thresholds):
        score = sum(weights[k] for k in numbers(text))
        return [1 / (1 + np.exp(-(score - t))) for t in thresholds]

    out = q.score_quality(docs, ratings)
    assert out.columns == ["doc_id", "text", "kept", "expected_grade", "tails", "_kept"]
    for r in out.collect():
        truth = tails(r.text or "", model.weights, model.thresholds)
        assert np.allclose(r.tails, truth) and np.isclose(r.expected_grade, sum(truth)) and r._kept == (truth[-1] >= 0.5)

    grades = {i: 2 if "good" in t else 1 if "Fine" in t else 0 for i, t in enumerate(texts)}

    def loss(weights, thresholds):
        total = 0.0
        for i, g in grades.items():
            up = [1.0, *tails(texts[i], weights, thresholds), 0.0]
            total -= np.log(max(up[g] - up[g + 1], 1e-12))
        return total / len(grades) + q.PENALTY * np.log(np.cosh(50 * weights)).sum() / 50

    best = loss(model.weights, model.thresholds)
    assert best < 0.25 * loss(np.zeros_like(model.weights), model.thresholds)
    for k in np.flatnonzero(model.weights)[:10]:  # no weight can be moved much for the better
        for step in (-0.3, 0.3):
            moved = model.weights.copy()
            moved[k] += step
            assert loss(moved, model.thresholds) > best - 2e-3


def test_thresholds_stay_in_order():
    rng = np.random.default_rng(0)
    n = 300
    number, row = rng.integers(0, 50, 3000).astype(np.int32), np.sort(rng.integers(0, n, 3000))
    model = fit_ordinal(number, row, rng.integers(0, 4, n))
    assert (np.diff(model.thresholds) > 0).all()
    assert fit_ordinal(number, row, np.ones(n, dtype=int)).thresholds.size == 0


@pytest.mark.parametrize("name", ["op1", "op8"])
def test_held_out_figures(spark, name):
    """Over the small test table: accuracy on held-out languages, and every copied test item found."""
    from millrace.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    query = next(q for k, q in QUERIES.items() if k.startswith(f"{name}_"))
    if name == "op8":
        out = query(spark, folder).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
        assert np.mean([r.lang == r.lang_pred for r in out]) >= 0.95
    else:
        items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
        truth = {r.doc_id for r in docs.collect() if any(t.lower() in r.text.lower() for t in items)}
        assert truth <= {r.doc_id for r in query(spark, folder).where("contaminated").collect()}
