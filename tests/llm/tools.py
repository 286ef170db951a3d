"""Small inputs with every awkward case, and plain-Python forms of the contracts."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_az(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def rows(seed=3, n=60):
    """Random texts, exact and near copies, a null and an empty text, repeated rows, a null id, a long text, ties."""
    r = random.Random(seed)
    vocabulary = ["the", "of", "Anna", "été", "straße", "x", "foo.", "bar,", "漢字", "e-mail", "1d10t", "***"] + [f"w{i}" for i in range(80)]
    out = []
    for i in range(n):
        text = " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))
        if i % 5 == 0:
            text = text.replace(" ", "\n", 3) + "\nsame line here\nsame line here"
        out.append((i, text, "en", f"s{i % 4}" if i % 7 else None, len(text)))
    long = " ".join(r.choice(vocabulary) for _ in range(30_000))
    near = (long + " tail").replace("w1 ", "w2 ", 3)
    base = " ".join(f"u{j}" for j in range(80))
    out += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \n\t ", "en", "s0", 4), (None, "no id at all", "en", "s1", 12), (103, long, "en", "s1", len(long)), (104, near, "en", "s2", len(near))]
    out += [(105, base, "en", "s1", 1), (106, base, "en", "s1", 1), (106, base, "en", "s1", 1), (107, base + " more", "en", "s3", 1), (108, base.upper(), "en", "s3", 1)]
    return out


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS)


def write(path, **tables):
    """A folder like the driver's."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)
