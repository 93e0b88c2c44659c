"""Every corpus operator on small hand-made tables, against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from farelens.llm import bpe, html_text, lines, minhash, mixing, neighbours, passages, quality, repeats, shards
from farelens.llm.registry import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string"
UPPER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeéö") for _ in range(rng.randint(2, 7))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base, passage = prose(120), prose(70)
    texts = [None, "", " \n\t ", "one two", "One Two", base, base, base.replace(base.split()[50], "changed", 1)]
    texts += [prose(80) + " " + passage + " " + prose(40) for _ in range(4)]
    texts += ["x " * 60, prose(30) + "\n" + prose(30) + "\nshared line of a site", "shared line of a site\n" + prose(20)]
    texts += [prose(rng.randint(1, 200)) + "\nshared line of a site" for _ in range(20)] + [prose(6000)]
    return texts, [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", 0, "extra", "extra") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus()[1], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mix_reaches_targets_and_agrees(docs, empty):
    texts, rows = corpus()
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    sizes = {i: len(words_of(t)) for i, t in enumerate(texts)}
    by_source = Counter()
    for i, *_, in rows:
        by_source[rows[i][3]] += sizes[i]
    order = sorted(by_source, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * by_source[s] < weight[s] * level}
        for s in full or open_:
            target[s] = 3.0 * by_source[s] if full else weight[s] * level
            left -= target[s] if full else 0
        open_ -= full or open_
    taken = Counter()
    for i, r in got.items():
        assert (r["size"], r["source_size"]) == (sizes[i], by_source[rows[i][3]])
        assert r["target"] == pytest.approx(target[rows[i][3]])
        assert r["taken"] in [k * sizes[i] for k in range(4)]
        taken[rows[i][3]] += r["taken"]
    assert sum(taken.values()) <= sum(sizes.values())
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(2)).collect()} == {i: r["taken"] for i, r in got.items()}
    repeated = mixing.mixed_documents(docs)
    assert repeated.columns == docs.columns
    copies = Counter(r["doc_id"] for r in repeated.collect())
    assert copies == Counter({i: r["copies"] for i, r in got.items() if r["copies"]})
    assert mixing.mix(empty).count() == 0


def test_mix_handles_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b", "en", "s", 0, "", "")] * 3 + [(1, None, "en", None, 0, "", "")]
    assert mixing.mix(spark.createDataFrame(rows, SCHEMA)).count() == 4


def test_lines(docs, empty):
    texts, rows = corpus()
    pages, total = Counter(), Counter()
    for i, t, _, s, *_ in rows:
        total[s] += 1
        for key in {x.strip(" \t\n\x0b\f\r") for x in (t or "").split("\n")} - {""}:
            pages[s, key] += 1
    for r in lines.drop_boilerplate(docs).collect():
        s, t = r["source"], texts[r["doc_id"]]
        if t is None:
            assert r["text"] is None and r["n_lines"] == 0
            continue
        drop = [p for p in t.split("\n") if pages[s, p.strip()] >= 3 and pages[s, p.strip()] > 0.1 * total[s] and p.strip()]
        assert r["n_dropped"] == len(drop)
        assert r["text"] == "\n".join(p for p in t.split("\n") if p not in drop)
    assert lines.drop_boilerplate(empty).count() == 0


def test_shards(spark, docs, empty):
    names = ["a", "b", "c"]
    table = shards.lookup_table(names, 1009)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = shards.lookup_table(names[:2], 1009)
    moved = sum(x != y for x, y in zip(table, fewer) if x != 2)
    assert moved < 0.2 * 1009
    placed = shards.assign_shards(docs, names, table_size=1009).collect()
    assert len(placed) == len(corpus()[0])
    for r in placed:
        slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % 1009
        assert (r["slot"], r["shard"], r["shard_name"]) == (slot, table[slot], names[table[slot]])
    assert shards.assign_shards(empty, names).count() == 0
    with pytest.raises(ValueError):
        shards.lookup_table(names, 1000)


def test_bpe_equals_the_library(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    library = Tokenizer.from_file(path)
    own = bpe.ForcedBoundaryBpe(path)
    rng = random.Random(3)
    letters = [*"ab cd'stT\n\t\r\x1c\x85\xa0　½é́中😀.,! ", "<|endoftext|>", "'ll", "  "]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert own.decode(own.encode(text).tobytes()) == library.decode(ids, skip_special_tokens=False)
    for r in bpe.encode_and_decode(docs, path).collect():
        text = corpus()[0][r["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r["n_tokens"], list(np.frombuffer(r["ids"], "<u4")), r["decoded"]) == (len(ids), ids, text)
    assert bpe.decode(bpe.encode(empty, path), path).count() == 0


def components_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_duplicates(docs, empty):
    texts, _ = corpus()
    sets = []
    for t in texts:
        w = words_of((t or "").translate(UPPER))
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    pairs = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    want = components_of(pairs, range(len(sets)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in range(len(sets))}
    assert minhash.drop_near_duplicates(docs).count() == len(set(want.values()))
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_made_of_shared_passages(spark):
    rng = random.Random(21)
    parts = [" ".join(drawn_words(rng, 30)) for _ in range(16)]
    taken = [sorted(rng.sample(range(16), 8)) for _ in range(400)]
    texts = [" ".join(parts[k] for k in chosen) for chosen in taken]
    ids = {}
    sets = []
    for t in texts:
        w = t.split()
        sets.append({ids.setdefault(tuple(w[i : i + 5]), len(ids)) for i in range(len(w) - 4)})
    near = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])]
    want = components_of(pairs, range(len(sets)))
    assert len(set(want.values())) > 10
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(table).collect()}
    assert got == want


def test_quality_counts(docs, empty):
    texts, _ = corpus()
    for r in quality.judge(docs).collect():
        t = texts[r["doc_id"]] or ""
        w = words_of(t)
        found = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {i + k for i in range(len(w) - 4) if found[tuple(w[i : i + 5])] > 1 for k in range(5)}
        kept_lines = [x for x in t.split("\n") if words_of(x)]
        failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(again))
        assert r["n_dup_lines"] == len(kept_lines) - len(set(kept_lines))
        assert r["base_failed"] == failed and r["kept"] == (not failed)  # too few rows for a fit
    assert quality.judge(empty).count() == 0


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rng = random.Random(5)

    def text(symbol):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) + symbol for _ in range(80))

    rows = [(i, text("%%%" if i % 10 == 0 else ""), "en", "s", 0, "", "") for i in range(200)]
    got = quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["kept"] == (r["doc_id"] % 10 != 0) for r in got)


def test_quality_rejects_shouted_texts_and_settles(spark):
    rng = random.Random(6)

    def text(i):
        drawn = [rng.choice("abcdefgéäж") + "".join(rng.choice("abcdefgéäж") for _ in range(rng.randint(2, 6))) for _ in range(80)]
        return " ".join(drawn).upper() if i % 10 == 0 else ". ".join(" ".join(drawn[k : k + 8]).capitalize() for k in range(0, 80, 8))

    texts = [text(i) for i in range(200)]
    table = spark.createDataFrame([(i, t, "en", "s", 0, "", "") for i, t in enumerate(texts)], SCHEMA)
    assert all(r["kept"] == (r["doc_id"] % 10 != 0) for r in quality.judge(table).collect())
    counts = quality.base_counts(table)
    for r in counts.collect():
        assert r["_q_capitals"] == sum(c.isupper() for c in texts[r["doc_id"]])


@pytest.mark.parametrize("most, chunk", [(5000, 2_000_000), (5000, 50), (1, 50)])
def test_repeats(docs, empty, most, chunk, monkeypatch):
    texts, _ = corpus()
    seen = set()
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    got = {r["doc_id"]: r for r in repeats.cut_repeats(docs, most_contexts=most).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        grams = [raw[k : k + 50] for k in range(len(raw) - 49)]
        gone = bytearray(len(raw))
        for k, gram in enumerate(grams):
            if gram in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update(grams)
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (len(raw), sum(gone), runs, kept)
    assert repeats.cut_repeats(empty).count() == 0


@pytest.mark.parametrize("own", [1, 1000])
def test_a_crowded_key_of_a_chunk_is_scanned_whole(own, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_CONTEXTS", own)
    gram = "the same four and twenty bytes, "
    texts = [f"{i:05d}" * 9 + gram + f"{i % 3:05d}" * 12 for i in range(40)]
    rows = []
    for part in (texts[:20], texts[20:]):
        found = [repeats.anchors(t.encode()) for t in part]
        ids = np.concatenate([np.full(len(f[0]), texts.index(t)) for f, t in zip(found, part)])
        columns = [np.concatenate([f[n] for f in found]) for n in (0, 2, 3)]
        rows += list(repeats._settle(ids, *columns, 4))
    rows.sort(key=lambda r: r[0])
    batch = pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows)], [str(n) for n in range(6)])
    wanted = {i for b in repeats._meet([batch]) for i in b.column(0).to_pylist()}
    assert wanted >= set(range(3, 40))


def test_intervals_of_a_sorted_list():
    got = set(repeats.intervals(sorted([b"abc", b"abd", b"ab", b"b"]), 1))
    assert {(2, 0, 2), (3, 1, 1), (3, 2, 2), (1, 3, 3)} <= got


def test_passages(docs, empty):
    rows = passages.near_passages(docs).collect()
    classes = {r["doc_id"]: r["class_id"] for r in rows}
    assert classes[6] == 5 and classes[7] == 5  # a copy and a near copy
    assert [classes.get(i) for i in (9, 10, 11)] == [8, 8, 8]  # one passage of 70 words
    assert not set(classes) & {0, 1, 2, 3, 4, 12, 35}
    assert passages.near_passages(empty).count() == 0


def drawn_words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_passages_meet_past_smaller_documents_with_a_part(spark):
    rng = random.Random(11)
    texts, pairs = [], []
    for _ in range(10):
        passage = drawn_words(rng, 55)
        parts = [passage[at : at + 48] for at in (0, 4, 7)]
        texts += [drawn_words(rng, 60) + part + drawn_words(rng, 60) for part in parts]
        pairs.append((len(texts), len(texts) + 1))
        texts += [drawn_words(rng, 70) + passage + drawn_words(rng, 70) for _ in range(2)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(min(r["doc_id"], r["other_id"]), max(r["doc_id"], r["other_id"])) for r in found} == set(pairs)
    assert all(r["n_words"] == 55 and r["start_word"] == 70 for r in found)


def test_two_texts_are_linked_by_each_passage_they_share(spark):
    rng = random.Random(13)
    texts, wanted = [], set()
    for _ in range(4):
        first, second = drawn_words(rng, 70), drawn_words(rng, 55)
        texts += [drawn_words(rng, 60) + second[at : at + 48] + drawn_words(rng, 60) for at in (0, 4, 7)]
        pair = len(texts), len(texts) + 1
        wanted |= {(*pair, 70), (*pair, 55)}
        texts += [drawn_words(rng, 70) + first + drawn_words(rng, 70) + second + drawn_words(rng, 9) for _ in range(2)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    ends = lambda r: (min(r["doc_id"], r["other_id"]), max(r["doc_id"], r["other_id"]), r["n_words"])
    assert {ends(r) for r in found} == wanted


def test_a_text_of_one_word_is_one_node():
    codes = passages.shingle_codes(passages.word_codes("again " * 8000))
    assert len(passages.compact_windows(codes)) == 1
    mixed_text = "one two three four five six " * 30 + "again " * 4000 + "seven eight nine ten eleven twelve " * 30
    assert len(passages.compact_windows(passages.shingle_codes(passages.word_codes(mixed_text)))) < 120


def test_alignment_bridges_what_stays_similar():
    rng = random.Random(12)
    codes = lambda ws: passages.shingle_codes(passages.word_codes(" ".join(ws)))
    passage, phrase = drawn_words(rng, 70), drawn_words(rng, 5)
    passage[10:15] = passage[45:50] = phrase
    a, b = codes(passage), codes(drawn_words(rng, 20) + phrase + drawn_words(rng, 20) + passage)
    assert passages._aligned(a, b) == [(0, 65, 45, 110, 1.0)]
    passage, far = drawn_words(rng, 90), drawn_words(rng, 60)
    (found,) = passages._aligned(codes(passage), codes(passage[:45] + far[:12] + passage[45:]))
    assert found[:4] == (0, 85, 0, 97) and found[4] == pytest.approx(82 / 102)
    assert passages._aligned(codes(passage), codes(passage[:45] + far + passage[45:])) == []
    half = codes(passage[:49])
    assert passages._aligned(half, half) == []


def test_compact_windows_group_every_run():
    hashes = np.random.default_rng(1).integers(0, 1000, 60)
    found = passages.compact_windows(hashes, 5)
    for i in range(60):
        for j in range(i + 4, 60):
            c = i + int(hashes[i : j + 1].argmin())
            assert sum(l <= i <= k <= j <= r and k == c for l, k, r in found) == 1


def test_neighbours(spark):
    x = np.random.default_rng(2).standard_normal((400, 8)).round(3)
    x[7] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (None, [1.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = neighbours.nearest_neighbours(table, table.where("vec_id % 10 = 0 OR vec_id = 3")).collect()
    exact = x.astype(np.float32).astype(float)
    hits = 0
    for q in [3, *range(0, 400, 10)]:
        d = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(400), d))[:10].tolist()
        mine = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        hits += len(set(best) & set(mine))
        assert len(mine) == 10
    assert hits >= 0.9 * 410
    few = table.where("vec_id < 3")
    assert neighbours.nearest_neighbours(few, few).count() == 6
    assert neighbours.nearest_neighbours(table.limit(0), table.limit(0)).count() == 0


def test_repeated_vectors_take_no_places(spark):
    x = np.random.default_rng(3).standard_normal((30, 4)).round(3)
    x[:15] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] * 2 + [(0, x[0].tolist())] * 12
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = neighbours.nearest_neighbours(table, table.where("vec_id = 3")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, 0.0) for i in range(11) if i != 3]


def test_html(spark):
    page = """<html><head><title>t</title><script>var a = "</p>";</script></head><body><nav><a href=x>Home</a></nav>
    <div class="cookie-notice">We use cookies to make the site better for you and for all of the others</div>
    <article><h1>A &lt;title&gt;</h1><p>The fox and the dog were in the house of the man that had been there for all of the
    time that was given &amp; more&#33;<br>Short.<form>Name of the form</form></article>
    <section id="comments"><p>I think that this is the best of all the articles that I have read</p></section>
    <footer>&copy; all of the rights are in the hands of the man</footer></body></html>"""
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<p>unclosed <b"), (5, "u", "<!-- open")]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == (
        "A <title> The fox and the dog were in the house of the man that had been there for all of the time that was "
        "given & more! Short."
    )
    assert [got[i]["text"] for i in (2, 3, 5)] == ["", "", ""]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def prose_of(i):
    return f"This is what was said of the house number {i} and of the man that had been there for all of the time that was given to him in it."


def test_html_blocks_decide_with_and_without_article():
    body = [prose_of(i) for i in range(6)]
    plain = "<body><div><h2>Head</h2>" + "".join(f"<p>{b}</p>" for b in body) + "</div>"
    assert html_text.main_text(plain) == "Head " + " ".join(body)
    teaser = "<article><h3><a href=x>Card</a></h3><p><a href=x>Read more</a></p></article>"
    assert html_text.main_text(plain + teaser * 4) == "Head " + " ".join(body)
    lead = f"<main><article><p>{body[0]}</p></article></main>"
    assert html_text.main_text(lead + "".join(f"<div>{b}</div>" for b in body[1:])) == " ".join(body)
    signed = f"{body[0]} The photo is © of the man and he has been in all of the books."
    figure = "<figure><figcaption>The house</figcaption></figure><p>It is <math><mi>x</mi></math></p>"
    page = f"<p>{signed}</p>{figure}<p>{body[1]}</p><p>© 2024 The Site</p><div>© 2024 The Site</div>"
    assert html_text.main_text(page) == f"{signed} The house It is x {body[1]}"


def test_html_wrappers_named_like_what_they_lay_out():
    body = [prose_of(i) for i in range(4)]
    inner = "".join(f"<p>{b}</p>" for b in body)
    side = f'<div class="sidebar"><p>{prose_of(7)}</p></div>'
    comments = "".join(f'<article class="comment-body"><p>{prose_of(20 + i)}</p></article>' for i in range(9))
    talk = f'<div class="comments-area"><ol class="comment-list">{comments}</ol></div>'
    for name in ("content-sidebar-wrap", "has-sidebar", "no-sidebar", "layout-with-menu", "search-result-page", "form-page"):
        for text in (inner, f"<article>{inner}</article>", f"<main>{inner}</main>"):
            assert html_text.main_text(f'<div class="page {name}">{text}{side}</div>{talk}') == " ".join(body)
    for name in ("sidebar", "menu"):
        assert html_text.main_text(f'<div id="{name}"><article>{inner}</article></div>{talk}') == " ".join(body)
    assert html_text.main_text('<div class="has-sidebar"><article><p>Short.</p></article></div>') == "Short."


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(r["exact"] for r in rows)
    assert not {r["doc_id"] for r in rows} & {0, 1, 2, 3, 4, 6, 7, 12}
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules"
