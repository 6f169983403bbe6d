import random

import numpy as np
import pytest
import sentencepiece

from daybook.llm import pieces
from daybook.llm.pieces import SPACE, Vocabulary


@pytest.fixture(scope="module")
def words():
    return Vocabulary.load()


def best_score(words, text):
    """A search over the whole text that keeps every boundary."""
    scores = [0.0] + [-1e300] * len(text)
    for end in range(1, len(text) + 1):
        scores[end] = scores[end - 1] + words.unknown
        for start in range(max(0, end - words.longest), end):
            known = words.pieces.get(text[start:end])
            if known:
                scores[end] = max(scores[end], scores[start] + known[1])
    return scores[-1]


def score(words, ids):
    by_id = dict(words.pieces.values())
    return sum(by_id[i] for i in ids)


def sample(seed, n):
    pick = random.Random(seed)
    stock = ["the", "Erst ", " ", "  ", "\n", "tion", "é", "日本", "\U0001f600", SPACE, "ß", "x", "0", "\t", "ing", "en ", "﷑"]
    return "".join(pick.choice(stock) for _ in range(n))


@pytest.mark.parametrize("seed", range(8))
def test_streamed_in_any_parts(words, seed):
    text = sample(seed, 300)
    whole = pieces.Encoder(words).encode(text)
    assert pieces.decode(words, whole) == text
    marked, pick = pieces._marked(" " + text), random.Random(seed)
    stream, ids, at = pieces.StreamingViterbi(words), [], 0
    while at < len(marked):
        step = pick.randint(1, 40)
        ids += stream.feed(marked[at : at + step])
        at += step
    assert ids + stream.finish() == whole.tolist()


def test_paths_are_the_best(words):
    encoder = pieces.Encoder(words)
    for seed in range(40):
        pick = random.Random(seed)
        text = " ".join("".join(pick.choices("theranditoxyz", k=pick.randint(1, 9))) for _ in range(12))
        ids = encoder.encode(text).tolist()
        assert score(words, ids) == pytest.approx(best_score(words, pieces._marked(" " + text)))


def test_no_worse_than_the_library(words):
    """The library searches the same pieces if the model file is marked as a unigram model."""
    model = open(pieces.VOCABULARY, "rb").read()
    at = model.rfind(b"\x18\x02 \x80")
    library = sentencepiece.SentencePieceProcessor(model_proto=model[:at] + b"\x18\x01" + model[at + 2 :])
    encoder, same = pieces.Encoder(words), 0
    stock = "retitioning ouen the thterthorreou with edble anwhon intion schkeit ungheit mente aux eau queé".split()
    for seed in range(200):
        text = " ".join(random.Random(seed).choices(stock, k=4))
        own, other = encoder.encode(text).tolist(), library.encode(text)
        assert score(words, own) >= score(words, other)
        same += own == other
    assert same > 20


def test_window_is_bounded(words):
    stream, most = pieces.StreamingViterbi(words), 0
    for _ in range(500):
        stream.feed("abcdefghij" * 10)
        most = max(most, len(stream.text))
    assert most <= 64 + 4 * words.longest


def test_whole_texts(docs, texts, nothing):
    rows = pieces.encoded(docs).collect()
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in rows)
    encoder = pieces.Encoder(Vocabulary.load())
    assert sorted(map(str, ((r.doc_id, r.ids) for r in rows))) == sorted(
        str((i, encoder.encode(t or "").tolist())) for i, t, *_ in texts
    )
    assert pieces.encoded(nothing).count() == 0


def test_other_vocabularies_are_not_cut_at_spaces(words):
    """With a piece that goes on after a space, the text goes through one search as a whole."""
    known = {**words.pieces, "n▁the": (5, 1e3)}
    prefixes = frozenset(p[:n] for p in known for n in range(1, len(p)))
    wide = Vocabulary(known, words.spelt, words.byte_ids, words.unknown, words.longest, pieces._endings(known), prefixes, False)
    assert 5 in pieces.Encoder(wide).encode("in the end").tolist()
    assert np.array_equal(pieces.Encoder(words).encode("of the end"), pieces.Encoder(wide).encode("of the end"))


def test_all_ids_come_from_commits_of_the_stream(spark, monkeypatch):
    """The texts of a given table: every segment is committed by the stream where its paths meet, before the text ends."""
    commits, ended = [], []
    plain = pieces.StreamingViterbi._commit
    monkeypatch.setattr(pieces.StreamingViterbi, "_commit", lambda self, upto: commits.append(self.text[:upto]) or plain(self, upto))
    monkeypatch.setattr(pieces.StreamingViterbi, "finish", lambda self: ended.append(1) or plain(self, len(self.text)))
    encoder = pieces.Encoder(Vocabulary.load())
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    segments = {x for t in texts if t for x in pieces._SEGMENT.findall(" " + t)}
    for text in texts:
        assert pieces.decode(encoder.words, encoder.encode(text or "")) == (text or "")
    committed = "".join(commits)
    assert not ended and len(segments) > 1_000 and len(committed) == sum(map(len, segments))
    # Most are committed in several steps or as a whole; none is longer than what was read of it.
    assert len([c for c in commits if c]) >= len(segments)


def test_the_stream_commits_as_soon_as_paths_meet(words):
    stream = pieces.StreamingViterbi(words)
    stream.feed(SPACE + "the")
    assert stream.settle(SPACE) != [] and stream.text == ""
    # Memory holds no more than the window while a text without spaces goes through.
    stream, most = pieces.StreamingViterbi(words), 0
    for k in range(2_000):
        stream.feed("xyzzyqua"[k % 8])
        most = max(most, len(stream.text))
    assert most <= 3 * words.longest


def test_meeting_paths_are_those_of_a_search_over_all_starts():
    words = Vocabulary.load()
    assert all(p[-2:] in words.prefix_ends for p in words.prefixes if len(p) > 1)
    for text in ("▁hello▁", "▁zqx\n", "▁▁▁", "▁inter", "▁Straße▁"):
        stream = pieces.StreamingViterbi(words)
        stream.text = text
        pieces._extend(words, text, stream.scores, stream.back)
        live = {s for s in range(max(0, len(text) - words.longest + 1), len(text)) if text[s:] in words.prefixes} | {len(text)}
        while len(live) > 1:
            high = max(live)
            live = live - {high} | {stream.back[high]}
        assert stream._meeting(text) == live.pop()
