import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.constants import RESERVED
from lexmill.functions.normalize import normalize
from lexmill.operators import unigram
from lexmill.operators.encode import detokenize, special_parts, tokenize
from lexmill.operators.lattice import Lattice, PieceIndex
from lexmill.operators.vocab import (
    VOCAB_SCHEMA,
    char_inventory,
    ids_to_tokens,
    load_vocab,
    reserved_pieces,
    save_vocab,
    tokens_to_ids,
    training_sample,
    vocab_table,
)

WORDS = "the of and nation order region 猫である 名前は まだ無い こんにちは 東京 大阪 123 4567 x".split()


@pytest.fixture(scope="module")
def texts():
    random.seed(6)
    return [
        " ".join(random.choices(WORDS, k=random.randint(1, 30))) + random.choice(["", ".", "\n!"])
        for _ in range(300)
    ]


@pytest.fixture(scope="module")
def corpus(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df.withColumn("text", normalize(F.col("text")))


@pytest.fixture(scope="module")
def vocab(corpus):
    return unigram.train_unigram(corpus, 120, seed_size=5000).cache()


def small_vocab(spark, pieces):
    rows = [(8 + i, p, s, "normal") for i, (p, s) in enumerate(pieces)]
    return reserved_pieces(spark).union(spark.createDataFrame(rows, VOCAB_SCHEMA))


def test_training_sample_order_and_limits(rows):
    df = rows([(3, "cc"), (1, ""), (2, "あ" * 5), (0, "a")], "id int, text string")
    assert [r.id for r in training_sample(df, ["id"], max_bytes=10).orderBy("id").collect()] == [0, 3]
    assert [r.id for r in training_sample(df, ["id"], sentences=2).orderBy("id").collect()] == [0, 2]


def test_char_inventory_keeps_until_covered(rows):
    df = rows([("aaaaaabbbc",)], "text string")
    kept = {r.ch: (r.n, r.kept) for r in char_inventory(df, coverage=0.6).collect()}
    assert kept == {"a": (6, True), "b": (3, False), "c": (1, False)}
    kept = {r.ch: r.kept for r in char_inventory(df, coverage=0.61).collect()}
    assert kept == {"a": True, "b": True, "c": False}


def test_vocabulary_layout(vocab):
    table = vocab.orderBy("id").collect()
    assert [(r.id, r.piece, r.kind) for r in table[:8]] == RESERVED
    assert [r.id for r in table] == list(range(120))
    learned = [r for r in table[8:]]
    assert all(r.kind == "normal" for r in learned)
    assert [r.score for r in learned] == sorted((r.score for r in learned), reverse=True)
    assert len({r.piece for r in table}) == 120
    shown = {r.id: r.surface for r in vocab_table(vocab).collect()}
    assert shown[7] == "\n" and shown[2] == "</s>"


def test_training_does_not_depend_on_partitions(corpus, vocab):
    again = unigram.train_unigram(corpus.repartition(3), 120, seed_size=5000)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, vocab.collect()))


def test_required_characters_are_in(corpus, vocab):
    kept = {r.ch for r in char_inventory(corpus).filter("kept").collect()} - {" ", "\n", "<", ">"}
    assert kept <= {r.piece for r in vocab.collect()}


def test_a_vocabulary_larger_than_the_text_is_an_error(corpus):
    with pytest.raises(ValueError, match="does not fit"):
        unigram.train_unigram(corpus, 4000, seed_size=5000)


def test_vocabulary_storage(spark, vocab, tmp_path):
    save_vocab(vocab, str(tmp_path / "v"))
    assert sorted(map(tuple, load_vocab(spark, str(tmp_path / "v")).collect())) == sorted(
        map(tuple, vocab.collect())
    )


def test_encoding_round_trip(corpus, vocab):
    ids = tokenize(corpus, vocab).cache()
    assert ids.filter("exists(input_ids, x -> x >= 120 or x < 0)").isEmpty()
    clean = ids.filter(~F.array_contains("input_ids", 3))
    back = {r.doc_id: r.text for r in detokenize(clean, vocab).collect()}
    want = {r.doc_id: r.text for r in corpus.collect()}
    assert back
    for doc, text in back.items():
        assert text == want[doc].replace("<n>", "\n") + "</s>"


SPECIAL_CASES = [
    ("[MASK]", ["[MASK]"]),  # alone
    ("<s><s></s>", ["<s>", "<s>", "</s>"]),  # side by side
    ("[CLS]nation", ["[CLS]", "nation"]),  # at the start
    ("nation[SEP]", ["nation", "[SEP]"]),  # at the end
    ("the <pad> of", ["the", "<pad>", "of"]),  # blanks beside one are outer blanks of a part
    ("\t the\u3000<unk>\n", ["the", "<unk>", ""]),
    ("[sep] <S> [mask", ["[sep] <S> [mask"]),  # other case and cut-off names are text
    ("１２<s>Ａ", ["12", "<s>", "A"]),  # parts are normalised one by one
    ("the of", ["the of"]),
    ("", [""]),
]


@pytest.mark.parametrize("text, expected", SPECIAL_CASES)
def test_special_tokens_are_parts_of_their_own(rows, text, expected):
    parts = rows([(text,)], "text string").select(special_parts(F.col("text"))).first()[0]
    assert [p for p in parts if p] == [p for p in expected if p]


def test_special_tokens_have_their_ids_and_rows_end(spark, vocab):
    known = {name: i for i, name, kind in RESERVED if kind != "user"}
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SPECIAL_CASES)], "doc_id int, text string")
    plain = {r.doc_id: r.input_ids for r in tokenize(df, vocab, add_special_tokens=False).collect()}
    ended = {r.doc_id: r.input_ids for r in tokenize(df, vocab).collect()}
    for i, (_, parts) in enumerate(SPECIAL_CASES):
        assert [t for t in plain[i] if t in known.values() and t != 3] == [known[p] for p in parts if p in known and p != "<unk>"]
        assert ended[i] == (plain[i] if plain[i][-1:] == [2] else [*plain[i], 2])


def test_unknown_runs_and_newlines(spark):
    vocab = small_vocab(spark, [("▁", -2.0), ("a", -2.0), ("b", -2.0), ("ab", -3.0), ("▁ab", -3.0)])
    df = spark.createDataFrame([(0, "☃☃ ☃ab ab\nb"), (1, ""), (2, "☃"), (3, None)], "id int, text string")
    ids = {r.id: r.input_ids for r in tokenize(df, vocab, add_special_tokens=False).collect()}
    assert ids == {0: [3, 8, 3, 11, 12, 7, 10], 1: [], 2: [3], 3: []}


def test_equal_scores_take_the_longest_piece(spark):
    vocab = small_vocab(spark, [("a", -1.0), ("aa", -2.0), ("aaa", -3.0)])
    df = spark.createDataFrame([(0, "aaaa")], "id int, text string")
    assert tokenize(df, vocab, add_special_tokens=False).first().input_ids == [8, 10]


@pytest.mark.parametrize("limit", [2, 1000])
def test_lookups(spark, limit):
    vocab = small_vocab(spark, [("a", -1.0), ("▁b", -2.0)])
    data = [(0, ["a", "▁b", "zzz", "<n>"]), (1, []), (2, ["</s>"])]
    df = spark.createDataFrame(data, "id int, tokens array<string>")
    ids = tokens_to_ids(df, vocab, limit)
    assert sorted(map(tuple, ids.collect())) == [(0, [8, 9, 3, 7]), (1, []), (2, [2])]
    back = ids_to_tokens(ids, vocab, limit)
    assert sorted(map(tuple, back.collect())) == [
        (0, ["a", "▁b", "<unk>", "\n"]),
        (1, []),
        (2, ["</s>"]),
    ]


def every_split(word, scores, unknown):
    """All segmentations of a word with their total scores."""
    if not word:
        return [((), 0.0)]
    out = []
    for n in range(1, len(word) + 1):
        head = word[:n]
        score = scores.get(head, unknown if n == 1 else None)
        if score is not None:
            out += [((head, *rest), score + s) for rest, s in every_split(word[n:], scores, unknown)]
    return out


def test_lattice_against_every_segmentation():
    random.seed(7)
    letters = "abc"
    pieces = sorted({"".join(random.choices(letters, k=random.randint(1, 3))) for _ in range(14)})
    scores = np.array([-random.random() * 5 for _ in pieces])
    table = dict(zip(pieces, scores))
    words = ["".join(random.choices(letters + "d", k=random.randint(1, 8))) for _ in range(60)]
    lattice = Lattice(PieceIndex(pieces), words)
    weight = lattice.weights(scores, -9.0)
    _, _, _, best = lattice.best(weight)
    counts = np.zeros(len(words))
    np.add.at(counts, lattice.word, lattice.expected(weight))
    for i, word in enumerate(words):
        paths = every_split(word, table, -9.0)
        assert best[i] == pytest.approx(max(s for _, s in paths))
        mass = np.array([np.exp(s) for _, s in paths])
        sizes = np.array([len(p) for p, _ in paths])
        assert counts[i] == pytest.approx((mass * sizes).sum() / mass.sum())


def test_digamma():
    harmonic = -0.5772156649015329
    for n in range(1, 30):
        assert float(unigram._digamma(n)) == pytest.approx(harmonic, abs=1e-9)
        harmonic += 1 / n


def test_parity_with_the_public_encoder_and_trainer(spark, corpus, vocab):
    spm = pytest.importorskip("sentencepiece")
    lines = [r.text for r in corpus.orderBy("doc_id").collect()]
    model = io.BytesIO()
    spm.SentencePieceTrainer.Train(
        sentence_iterator=iter(lines), model_writer=model, vocab_size=120, minloglevel=2,
        character_coverage=0.9995, pad_id=0, bos_id=1, eos_id=2, unk_id=3,
        control_symbols=["[SEP]", "[CLS]", "[MASK]"], user_defined_symbols=["<n>"],
        add_dummy_prefix=False, shuffle_input_sentence=False,
    )
    package = spm.SentencePieceProcessor(model_proto=model.getvalue())
    kinds = [
        "control" if package.is_control(i) else "unknown" if package.is_unknown(i) else "normal"
        for i in range(120)
    ]
    kinds[7] = "user"
    rows = [(i, package.id_to_piece(i), package.get_score(i), k) for i, k in enumerate(kinds)]
    theirs = spark.createDataFrame(rows, VOCAB_SCHEMA)
    ours = tokenize(corpus, theirs, add_special_tokens=False).orderBy("doc_id").collect()
    assert [r.input_ids for r in ours] == package.encode(lines)
    mine = tokenize(corpus, vocab, add_special_tokens=False)
    total = mine.agg(F.sum(F.size("input_ids"))).first()[0]
    assert total <= 1.05 * sum(len(x) for x in package.encode(lines))
