"""The whole pipeline against the same five stages in plain Python (mixing in DuckDB's SQL)."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd

from farelens.llm import quality
from farelens.llm.registry import ORACLE_OP1, tokenizer_path
from tests.llm.test_quality_fits import distances, settled

BLANKS = " \t\n\x0b\f\r"
UPPER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def statistics(text):
    """(base failed, the seven statistics in thousandths)."""
    text = text or ""
    ws = words_of(text)
    windows = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    again = len({i + k for i in range(len(ws) - 4) if windows[tuple(ws[i : i + 5])] > 1 for k in range(5)})
    lines = [x for x in text.split("\n") if words_of(x)]
    chars = sum(map(len, ws))
    values = [
        math.log1p(len(ws)),
        chars / max(1, len(ws)),
        sum(c in "#*$%&|<>" for c in text) / max(1, chars),
        sum(c in "!?" for c in text) / max(1, chars),
        sum(c.isupper() for c in text) / max(1, chars),
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        again / max(1, len(ws)),
    ]
    failed = len(ws) < 10 or 100 * again > 20 * len(ws)
    return failed, [min(math.floor(v * 1000 + 0.5), 100_000) for v in values]


def sound(rows):
    told = [statistics(r["text"]) for r in rows]
    good = [i for i, (failed, _) in enumerate(told) if not failed]
    names = [lambda r: (r["lang"], r["source"]), lambda r: (r["lang"],), lambda r: ()]
    members = [defaultdict(list) for _ in names]
    for i in good:
        for level, name in zip(members, names):
            level[name(rows[i])].append(told[i][1])
    fits, kept = {}, []
    for i in good:
        level = next((k for k in range(3) if len(members[k][names[k](rows[i])]) >= quality.LEAST_ROWS), None)
        if level is not None:
            key = level, names[level](rows[i])
            if key not in fits:
                fits[key] = settled(np.array(members[level][key[1]]))
            if distances(np.array([told[i][1]]), fits[key])[0] > quality.CUTOFF:
                continue
        kept.append(rows[i])
    return kept


def without_shared_lines(rows):
    pages, total = defaultdict(set), Counter(r["source"] for r in rows)
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if line.strip(BLANKS):
                pages[r["source"], line.strip(BLANKS)].add(r["doc_id"])

    def stays(r, line):
        n = len(pages[r["source"], line.strip(BLANKS)])
        return not line.strip(BLANKS) or n < 3 or n <= 0.1 * total[r["source"]]

    out = []
    for r in rows:
        text = r["text"] and "\n".join(x for x in r["text"].split("\n") if stays(r, x))
        out.append(dict(r, text=text, n_chars=len(text)))
    return out


def one_of_each(rows):
    sets = []
    for r in rows:
        w = words_of((r["text"] or "").translate(UPPER))
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = [r["doc_id"] for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    return [r for r, least in zip(rows, root) if r["doc_id"] == least]


def mixed(rows):
    documents = pd.DataFrame(rows)  # noqa: F841 (read by name)
    taken = duckdb.sql(ORACLE_OP1).df().set_index("doc_id")
    return [r for r in rows for _ in range(int(taken.loc[r["doc_id"], "taken"] // max(1, taken.loc[r["doc_id"], "size"])))]


def corpus():
    rng = random.Random(31)
    vocabulary = ["".join(rng.choice("abcdeéö") for _ in range(rng.randint(2, 7))) for _ in range(500)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    texts = [prose(rng.randint(40, 120)) + ("\nall rights reserved" if k % 3 else "") for k in range(190)]
    texts += [re.sub(" ", "%%% ", prose(70)) for _ in range(9)] + [prose(80).upper() for _ in range(4)]
    texts += [None, "", "few words", "x " * 60]
    base = texts[3].split("\n")[0].split()
    texts += [texts[5], " ".join([*base[:-1], "changed"]), " ".join(["Changed", *base[1:]])]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [
        {"doc_id": k, "text": texts[i], "lang": "en" if i % 40 else None, "source": f"s{i % 2}" if i % 9 else "rare", "n_chars": len(texts[i] or "")}
        for k, i in enumerate(order)
    ]


def test_pipeline_equals_plain_python(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    names = [c.split()[0] for c in schema.split(", ")]
    spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    first = sound(rows)
    assert 150 < len(first) < len(rows) - 15
    wanted = mixed(one_of_each(without_shared_lines(first)))
    coder = Tokenizer.from_file(tokenizer_path())
    want = Counter((r["doc_id"], r["lang"], r["source"], tuple(coder.encode(r["text"], add_special_tokens=False).ids)) for r in wanted)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["lang"], r["source"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    assert all(r["exact"] and 4 * r["n_tokens"] == len(r["ids"]) for r in got)
