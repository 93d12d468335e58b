import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from seqlattice.llm import fingerprints as fp
from seqlattice.llm import queries


def _plain_vector(raw: bytes) -> list[int]:
    """One paragraph after the other, one window after the other."""
    from seqlattice.llm.common import WordHashes, mix

    out, words = [0] * (fp.DIGEST + fp.LANES), WordHashes()
    for line in raw.split(b"\n"):
        split = line.split()
        if not split:
            continue
        digest = hashlib.shake_128(line).digest(4 * fp.DIGEST)
        for i in range(fp.DIGEST):
            out[i] += int.from_bytes(digest[4 * i : 4 * i + 4], "little")
        windows = {tuple(split[i : i + 3]) for i in range(max(1, len(split) - 2))}
        for w in windows:
            h = 0
            for word in w:
                h = (h * 0x9E3779B97F4A7C15 + words[word] + 1) % (1 << 64)
            h = int(mix(np.array([h], np.uint64))[0])
            out[fp.DIGEST + (h >> 1) % fp.LANES] += -1 if h & 1 else 1
    return [x % (1 << 32) for x in out]


TEXTS = [b"", b" \n\t", b"one", b"one two", b"a b c d e\na b c d e\n\nx y", "ä b\x85c é".encode(), b"w " * 500, b"one two\nthree four five six"]


def test_vectors_equal_plain_sums():
    for raw in TEXTS:
        assert fp.vector(raw).tolist() == _plain_vector(raw)
        assert fp.decode(fp.encode(fp.vector(raw))).tolist() == fp.vector(raw).tolist()


def test_order_of_paragraphs_does_not_matter_but_their_number_and_words_do():
    a, b = b"first line here\nsecond line there", b"second line there\nfirst line here"
    assert fp.encode(fp.vector(a)) == fp.encode(fp.vector(b))
    others = [a + b"\nsecond line there", b"first line here second line there", b"first here line\nsecond line there", b"first  line here\nsecond line there"]
    assert len({fp.encode(fp.vector(x)) for x in [a, *others]}) == 5


def test_paragraphs_are_put_in_and_taken_out():
    rng = random.Random(3)
    lines = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 12))).encode() for _ in range(60)]
    now = fp.vector(b"")
    for line in lines:
        now = fp.insert(now, line)
    assert now.tolist() == fp.vector(b"\n".join(lines)).tolist()
    for line in lines[:30]:
        now = fp.delete(now, line)
    assert now.tolist() == fp.vector(b"\n".join(lines[30:])).tolist()


def test_lanes_wrap_and_are_written_whole():
    big = fp.vector(b"x y z")
    for scale in (1, 1000, (1 << 31) - 1, 1 << 31):
        lanes = (big * np.uint64(scale)) & np.uint64(0xFFFFFFFF)
        assert fp.decode(fp.encode(lanes)).tolist() == lanes.tolist()


def test_likeness_follows_what_is_shared(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 50_000)}"
    off = []
    for n in (40, 400, 4000):
        for share in (0.0, 0.25, 0.5, 0.75, 1.0):
            a = [word() for _ in range(n)]
            b = a[: int(n * share)] + [word() for _ in range(n - int(n * share))]
            off.append(fp._cosine(fp.vector(" ".join(a).encode()), fp.vector(" ".join(b).encode())) - share)
    assert max(map(abs, off)) < 0.2 and abs(float(np.mean(off))) < 0.05
    rows = spark.createDataFrame([("a b c d", "a b c d"), (None, ""), ("a b c d", None), ("a b c", "x y z")], "x string, y string")
    assert [r.s for r in rows.select(fp.likeness(fp.fingerprint(F.col("x")), fp.fingerprint(F.col("y"))).alias("s")).collect()][:3] == [1.0, 1.0, 0.0]


def _plain_pairs(rows):
    """(id, n_chars, edited_sha256, fingerprints) of rows already in order."""
    out = []
    for i, (id_, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        sums = [np.array(_plain_vector(x.encode()), np.uint64) for x in (text, new, after)]
        out.append((id_, len(text), hashlib.sha256(new.encode()).hexdigest(), fp.encode(sums[0]), fp.encode(sums[1]), round(fp._cosine(sums[0], sums[1]), 9), round(fp._cosine(sums[0], sums[2]), 9)))
    return Counter(out)


def _rows(found):
    return Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in found.collect())


def test_query_equals_plain_version(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]
    found = queries.op13_document_fingerprints(spark, small)
    assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert _rows(found) == _plain_pairs(docs)


def test_neighbours_across_partitions_and_defined_cases(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "a", "é\U0001f600 b", "long words " * 20_000, "x\ny\n\nz", "x\ny\n\nz"] + [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 40))) for _ in range(50)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "p", 1, "e") for i, t in rows], "doc_id long, text string, part string, id int, edge string")
    for n in ("1", "7"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert _rows(fp.edited_pairs(docs)) == _plain_pairs(rows)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    alone = docs.filter("doc_id = 3")
    assert _rows(fp.edited_pairs(alone)) == _plain_pairs([(3, "a")])
    assert fp.edited_pairs(docs.limit(0)).count() == 0
    repeated = docs.filter("doc_id = 4").unionByName(docs.filter("doc_id = 4")).unionByName(docs.filter("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    assert _rows(fp.edited_pairs(repeated)) == _plain_pairs([(None, texts[4]), (4, texts[4]), (4, texts[4])])
