"""The whole pipeline against a brute-force version of each stage, on a small table with every kind of row."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrane.llm import neardup, queries

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def some(draw, n, letters):
    return [" ".join("".join(draw.choice(letters) for _ in range(draw.randint(3, 9))) for _ in range(draw.randint(6, 12))) for _ in range(n)]


def fixture():
    draw, docs = random.Random(21), []
    for i in range(40):
        lang, letters = (("en", "aeioutnsrhl"), ("de", "äöüßekmnrz"))[i % 2]
        docs.append([i, "\n".join(some(draw, 30, letters)), lang, f"site{i % 8}"])
    for i in range(0, 16):  # boilerplate of two lines on eight sites
        docs[i][1] = "All rights are reserved by the owner of this site\n" + docs[i][1] + "\n\n  Follow us and read the news every day  "
    passage = " ".join(some(draw, 9, "aeioutnsrhl"))
    for i in (3, 20, 31):  # a passage of over fifty words
        lines = docs[i][1].split("\n")
        docs[i][1] = "\n".join([*lines[:9], passage, *lines[9:]])
    docs += [[50, docs[5][1], "de", "site1"], [51, docs[22][1].replace(docs[22][1].split()[4], "other"), "en", None], [52, docs[51 - 40 + 0][1], None, "x"]]
    docs += [[60, None, "en", "a"], [61, "", "en", "a"], [62, "12 34 !!", "en", "a"], [63, " \n\t", None, None], [64, "ok", "en", "b"], [None, docs[7][1], None, "c"], [64, "ok", "en", "b"]]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in docs]


def brute_lines(docs):
    bare = lambda x: x.translate(str.maketrans("\t\x0b\x0c\r", "    ")).strip(" ")
    sites = defaultdict(set)
    for _, t, _, s, _ in docs:
        for line in (t or "").split("\n"):
            sites[bare(line)].add(s)
    out = []
    for i, t, lang, s, n in docs:
        if t is not None:
            lines = t.split("\n")
            gone = [bool(bare(x)) and len(sites[bare(x)]) >= 5 for x in lines]
            if 9 * sum(len(bare(x)) for x, g in zip(lines, gone, strict=True) if g) <= 8 * sum(len(bare(x)) for x in lines):
                t = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((i, t, lang, s, n))
    return out


def brute_near(docs):
    rows = list(dict.fromkeys(docs))  # rows that repeat id and text are one, if they have a word
    sets = [set(neardup.shingle_set(t.encode(), 5).tolist()) for _, t, *_ in rows]
    kept, order = [], sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    component: dict[int, int] = {}
    for k in order:
        if k not in component:
            stack = [k]
            component[k] = k
            kept.append(rows[k])
            while stack:
                x = stack.pop()
                for y in order:
                    if y not in component and sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                        component[y] = k
                        stack.append(y)
    return kept


def brute_passages(docs, least=50):
    earlier, out = [], []
    for i, t, *rest in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        words = [w.lower() for w in WORD.findall(t)]
        covered = np.zeros(len(words), bool)
        for other in earlier:
            at = defaultdict(list)
            for k in range(len(other) - least + 1):
                at[tuple(other[k : k + least])].append(k)
            for k in range(len(words) - least + 1):
                if tuple(words[k : k + least]) in at:
                    covered[k : k + least] = True
        if i is not None:
            earlier.append(words)
            starts = [m.start() for m in WORD.finditer(t)] + [len(t)]
            if covered.any():
                edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(int), [0]))))
                for a, b in reversed(list(zip(edges[::2], edges[1::2], strict=True))):
                    t = t[: starts[a]] + t[starts[b] :]
        if WORD.search(t) or not covered.any():
            out.append((i, t, *rest))
    return out


def test_the_pipeline_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = fixture()
    spark.createDataFrame(docs, DOC).withColumn("extra", F.lit(1)).drop("extra").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect():
        got[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    rest = brute_passages(brute_near(brute_lines([d for d in docs if d[1] and re.search(r"[^\W\d_]", d[1])])))
    assert 31 <= len(rest) < len(docs) - 8 and {20, 31, 64} <= {d[0] for d in rest} and None not in {d[0] for d in rest}
    tok, want = Tokenizer.from_str(queries.vocabulary("byte_bpe_50k.json").decode()), defaultdict(list)
    for i, t, *_ in rest:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want[i, len(ids)] += [(k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_empty_and_odd_tables(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, "s", 0), (2, "", "en", None, 0), (3, "x", None, None, 1), (3, "x", None, None, 1), (None, "x", None, "s", 1), (4, "1 2", "de", "s", 3)], DOC)
    for rows, want in ((odd.limit(0), []), (odd, {"language_id": [3, 3, None], "near_dedup": [1, 2, 3, 4, None]}.get(name, [1, 2, 3, 3, 4, None, None]))):
        out = stage(spark, rows, "")
        assert name == "packing" or out.columns == odd.columns
        assert sorted((r["doc_id"] for r in out.select("doc_id").collect()), key=lambda x: (x is None, x)) == want


def test_texts_in_an_unknown_script_go(spark):
    draw = random.Random(2)
    rows = [(i, " ".join(some(draw, 20, "aeioutnsrhl")), "en", "s", 0) for i in range(60)] + [(100 + i, " ".join(some(draw, 20, "жзийклмнопрст")), None, "s", 0) for i in range(5)] + [(200, "короткий", None, "s", 0)]
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, spark.createDataFrame(rows, DOC), "").collect()}
    assert kept == {*range(60), 200}
