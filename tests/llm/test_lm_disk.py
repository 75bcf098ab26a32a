"""What a language model's levels shuffle is gone once they are answered, and a level goes through in ranges of shards."""

import os
import time

from data import frame

from tremolo.llm import lm_scoring


def shuffled(spark) -> int:
    """Bytes of shuffle files that this session keeps."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    paths = [files.apply(i).getPath() for i in range(files.size())]
    return sum(os.path.getsize(p) for p in paths if os.path.basename(p).startswith("shuffle_") and os.path.exists(p))


def test_levels_leave_no_shuffle_files(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD", 500)
    ranges, left, whole = [], [], lm_scoring.written

    def written(df, name, **more):
        before = shuffled(spark)
        out = whole(df, name, **more)
        until = time.time() + 10  # files go in the background
        while (now := shuffled(spark) - before) > 0 and time.time() < until:
            time.sleep(0.1)
        left.append(now)
        return out

    asked = lm_scoring.answers
    monkeypatch.setattr(lm_scoring, "written", written)
    monkeypatch.setattr(lm_scoring, "answers", lambda table, shards, level, hot, start, stop: ranges.append((level, start, stop, shards)) or asked(table, shards, level, hot, start, stop))
    rows = [(i, " ".join(f"w{(i * j * 31 + j) % 97}" for j in range(40))) for i in range(50)]
    assert lm_scoring.score(frame(spark, rows)).count() == 50
    assert max(left) <= 0  # garbage of earlier jobs may go meanwhile
    shards = ranges[0][3]
    assert shards > 1
    for level in (1, 2, 3):  # every shard once
        own = [(a, b) for lv, a, b, _ in ranges if lv == level]
        assert own[0][0] == 0 and own[-1][1] == shards and all(x[1] == y[0] for x, y in zip(own, own[1:]))
    assert len([r for r in ranges if r[0] == 3]) == lm_scoring.PASSES


def test_blocks_cut_from_batches(spark, monkeypatch):
    """A batch's later blocks have their own words, whatever white space is around them."""
    monkeypatch.setattr(lm_scoring, "BLOCK", 64)
    rows = [(i, x) for i, x in enumerate(["", None, " \t", "A b c  É\x0b", "\r\nd e f ", "\x1cg h\x85 I", "word " * 40, "Z"] * 4)]
    got = {r.doc_id: r.n_tokens for r in lm_scoring.score(frame(spark, rows).coalesce(1)).collect()}
    assert got == {i: len((x or "").encode().lower().split()) + 1 for i, x in rows}
