import random

import pytest

WORDS = "the of and in to a that it is was for on are with as his they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she".split()


@pytest.fixture(scope="session")
def prose():
    """Texts of a random vocabulary: (seed, number of words) to text with a line end now and then."""

    def make(seed, n):
        r = random.Random(seed)
        syllables = "ka lo mi tu re sa no vi pe du".split()
        words = [r.choice(WORDS) if r.random() < 0.3 else "".join(r.choice(syllables) for _ in range(r.randint(2, 4))) for _ in range(n)]
        return "".join(w + ("\n" if i % 23 == 22 else " ") for i, w in enumerate(words)).strip()

    return make


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def table(spark):
    """Documents with columns whose names clash with those of results."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], DOCUMENTS)
        if extra:
            for c in ("size", "shard", "slot", "node", "root", "score", "rank", "key", "part", "removed_", "class_id", "_key", "worded", "_node", "_first", "_copied", "removed", "n_lines", "_id", "_row_key", "row_key", "lost", "first", "id", "block", "packed", "class", "at", "bytes"):
                df = df.withColumn(c, df["doc_id"])
        return df

    return make
