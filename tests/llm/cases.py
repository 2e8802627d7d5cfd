"""Small tables with what breaks operators: nulls, empty, blank and long texts, repeats, repeated rows, clashing columns."""

import random

from pyspark.sql import functions as F

CLASH = ("text_key", "row", "spans", "start", "item", "set", "rank", "segment", "found", "keep", "mini", "word", "window_id", "length", "bucket", "code", "class", "half")


def rows(seed=5, n=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(50)]
    passage = " ".join(f"p{i}" for i in range(70))
    made = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    base = made(90)
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            text = made(rnd.randrange(1, 120))
        elif kind == 1:
            text = base
        elif kind == 2:
            words = base.split()
            for _ in range(rnd.randrange(4)):
                words[rnd.randrange(len(words))] = "edit" + str(rnd.randrange(9))
            text = " ".join(words)
        elif kind == 3:
            text = made(20) + " " + passage + "\n" + made(15)
        elif kind == 4:
            text = "Ein Ärger mit ßeltsamen Zeichen é è. " * rnd.randrange(1, 30)
        else:
            text = made(12) + "\n" + base[:200] + "\n" + made(9) + "\nshort\n\nshort"
        out.append((i, text))
    out += [(100, None), (101, ""), (102, "   "), (103, "\n\n"), (104, "one"), (105, "ONE"), (None, base), (None, None), (106, base + " " + "q " * 3000), (107, "a" * 5000), (108, "a" * 5000), (7, out[7][1]), (7, out[7][1]), (109, "!!! ???")]
    return out


def frame(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string")
    for k, name in enumerate(CLASH):
        df = df.withColumn(name, F.lit(k))
    return df.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))


def thue_morse(n, letters="ab"):
    """A string that has the same hash, modulo 2**64, as the one with its two letters swapped, whatever the base."""
    return "".join(letters[i.bit_count() & 1] for i in range(n))


def twins():
    """Rows with long words, and lines, that a hash modulo 2**64 takes for each other."""
    shared = " ".join(f"common{i}" for i in range(60))
    out = []
    for k, n in enumerate((1024, 2048, 4096, 8192)):
        for letters in ("ab", "ba"):
            word = thue_morse(n, letters)
            out.append((len(out), word))
            out.append((len(out), f"{shared.rsplit(' ', 11)[0]} {word}\n{word} one two three {k}"))
            out.append((len(out), f"{word}{word}"))
    return out + [(100, out[1][1]), (101, shared), (102, "some other words " + shared)]
