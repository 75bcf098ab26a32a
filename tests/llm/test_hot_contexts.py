"""Hot contexts are split without changing a score beyond the codes' steps."""

import numpy as np
from data import frame

from tremolo.llm import lm_scoring


def test_split_contexts(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(x for _ in range(60) for x in ("the", f"w{rng.integers(40)}"))) for i in range(120)]
    df = frame(spark, rows)
    whole = {r.doc_id: r for r in lm_scoring.score(df).collect()}
    monkeypatch.setattr(lm_scoring, "SHARD", 2000)
    split = {r.doc_id: r for r in lm_scoring.score(df).collect()}
    monkeypatch.setattr(lm_scoring, "SPLIT", 1)
    one = {r.doc_id: r for r in lm_scoring.score(df).collect()}
    for i, r in whole.items():
        assert split[i].base_score == r.base_score and split[i].n_known == r.n_known
        assert abs(split[i].score - r.score) < 0.0004 * r.n_tokens
        assert abs(one[i].score - r.score) < 0.0004 * r.n_tokens


def test_query_uses_two_words_of_context(spark):
    """Documents of equal words and pairs, but whose triples are seen or not."""
    rows = [(None, text) for text in ("a x p", "b x q") for _ in range(50)] + [(29, "a x p"), (37, "a x q")]  # these two are held out
    got = {r.doc_id: r for r in lm_scoring.score(frame(spark, rows)).collect()}
    assert got[29].held_out and got[37].held_out and got[29].base_score == got[37].base_score
    assert got[29].score > got[37].score + 0.5
