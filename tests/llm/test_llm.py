from __future__ import annotations

import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalis.llm import bwtmerge, chat, decontaminate, editcount, exchange, html, interleave, itq, jaccard, packing, recompress, tokens, toxicity

WORDS = ["the", "of", "thing", "and", "été", "stone", "River,", "x9", "a", "moon."]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (str(rng.randint(0, 999)) if rng.random() < 0.5 else "") for _ in range(n))


def corpus(seed: int = 5) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    passage, long = prose(rng, 60), prose(rng, 3000)
    rows: list[tuple[int | None, str | None]] = [(i, prose(rng, rng.randint(0, 160))) for i in range(40)]
    rows += [(100 + i, f"{prose(rng, 30)} {passage}\n{prose(rng, 20)}") for i in range(8)]
    base = prose(rng, 150)
    rows += [(200 + i, base.replace(" ", "\n", i).replace("moon.", "sun", i)) for i in range(8)]
    rows += [(300, long), (301, long[: len(long) // 2] + " cut " + long[len(long) // 2 :]), (302, "a " * 200), (303, "ab" * 300)]
    rows += [(400, base), (400, base), (401, ""), (402, None), (403, " \t "), (404, "One"), (405, "one"), (None, "Two words"), (406, passage), (407, "日本語 " * 60)]
    return rows


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, n_words string").repartition(parts)


def key(rows):
    return sorted(map(str, map(tuple, rows)))




def test_encoder_equals_direct_calls():
    e = tokens.encoder(tokens.default_tokenizer())
    rng = random.Random(1)
    alphabet = "aAbßÉéÑ'sStTreE1٣½²µİΣςé́<|endoftext|>\t\n  \x1c\x85-.,\"$ÿ​日本"
    for _ in range(3000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert e.ids(s) == e.whole(s)


def test_packing_covers_every_id(spark):
    rows = corpus() + [(900, "word " * 9000)]
    got = packing.pack_documents(frame(spark, rows), keep_ids=True).collect()
    e = tokens.encoder(tokens.default_tokenizer())
    want = sorted((str(i), *(np.frombuffer(e.whole(t or ""), "<u4").tolist() + [2])) for i, t in rows)
    by: dict = {}
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by.setdefault(str(r.doc_id), []).append(r)
    docs = []
    for i, pieces in by.items():
        pieces.sort(key=lambda r: r.start)
        total = pieces[0].doc_tokens
        if sum(p.length for p in pieces) == total:
            docs.append((i, *(x for p in pieces for x in p.ids)))
        else:  # repeated rows: equal documents
            assert sum(p.length for p in pieces) % total == 0
            docs += [w for w in want if w[0] == i]
    assert sorted(docs) == want
    seqs: dict = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096 and len(s) <= packing.MAX_SEGMENTS
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_example_bins_keep_all_limits(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(1, 900), rng.randint(1, 9), rng.randint(0, 500)) for i in range(200)] + [(999, 5000, 1, 1), (1000, None, 1, 1)]
    got = packing.pack_examples(spark.createDataFrame(rows, "i long, t long, s long, l long").coalesce(1), "i", "t", "s", "l", 2048, 16, 1000).collect()
    size = {r[0]: r[1:] for r in rows}
    bins: dict = {}
    for r in got:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(size[r.example_id])
    assert len(got) == 202 and [r.bin_id for r in got if r.example_id == 999] == [None]
    assert all(sum(x[0] or 0 for x in b) <= 2048 and sum(x[1] for x in b) <= 16 and sum(x[2] for x in b) <= 1000 for b in bins.values())


def test_examples_fill_bins_across_windows(spark, monkeypatch):
    """Each of the three limits binds for some examples; no bin breaks one, and few stay half empty."""
    monkeypatch.setattr(packing, "WINDOW_ITEMS", 64)
    rng = random.Random(9)
    kinds = [lambda: (rng.randint(300, 900), 1, rng.randint(1, 50)), lambda: (rng.randint(1, 20), rng.randint(2, 6), 1), lambda: (rng.randint(150, 300), 1, rng.randint(140, 150))]
    rows = [(i, *rng.choice(kinds)()) for i in range(1500)]
    got = packing.pack_examples(spark.createDataFrame(rows, "i long, t long, s long, l long").coalesce(1), "i", "t", "s", "l", 2048, 16, 600).collect()
    size, bins = {r[0]: np.array(r[1:]) for r in rows}, {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(size[r.example_id])
    limits = np.array([2048, 16, 600])
    full = np.array([sum(b) / limits for b in bins.values()])
    assert sorted(r.example_id for r in got) == list(range(1500)) and (full <= 1).all()
    assert len(bins) <= 1.15 * max(sum(size.values()) / limits) and (full.max(1) < 0.9).mean() < 0.1
    assert (full >= 0.9).any(0).all()


def test_edit_trees_equal_full_counts():
    from tokenizers import Tokenizer

    c = editcount.counter(editcount.default_tokenizer())
    full = Tokenizer.from_file(editcount.default_tokenizer())
    full.encode_special_tokens = True
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "'", "s", "'ll", "9", "!?", "é", "the ", " word", "日", "xxx"]
    for _ in range(300):
        s = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 30, 400])))
        tree = editcount.TokenTree(s, c)
        for _ in range(4):
            a = rng.randint(0, len(s) + 1)
            b, new = a + rng.choice([0, 1, 3, 200]), "".join(rng.choice(parts) for _ in range(rng.choice([0, 2, 99])))
            tree.edit(a, b, new)
            a = min(a, len(s))
            s = s[:a] + new + s[max(a, min(b, len(s))) :]
            assert tree.text() == s and tree.n_tokens == len(full.encode(s, add_special_tokens=False).ids)


def test_large_insertions_split_leaves():
    c = editcount.counter(editcount.default_tokenizer())
    tree = editcount.TokenTree("start end", c)
    tree.edit(5, 5, " word" * 5000)
    assert max(map(len, tree.leaves)) <= editcount.LEAF * editcount.LARGE and tree.n_tokens == editcount.TokenTree(tree.text(), c).n_tokens
    spent = tree.encoded
    tree.edit(10_000, 10_003, "x")
    assert tree.encoded - spent < 60 and tree.n_tokens == editcount.TokenTree(tree.text(), c).n_tokens


def test_kept_trees_follow_edits(spark):
    rows = corpus()
    docs = frame(spark, rows).withColumn("edits", editcount.standard_edits())
    trees = editcount.token_trees(docs)
    key_of = trees.withColumn("k", F.monotonically_increasing_id())
    assert key(trees.select("doc_id", "n_tokens").collect()) == key(editcount.count_after_edits(docs).select("doc_id", "tokens_before").collect())
    edits = F.expr("array(struct(2 AS start, 4 AS end, 'new words' AS new), null, struct(null AS start, null AS end, null AS new))")
    edited = editcount.edit_trees(key_of.withColumn("edits", edits)).collect()
    want = editcount.count_after_edits(docs.withColumn("edits", edits)).collect()
    assert key((r.doc_id, r.n_tokens, r.pretokens_encoded) for r in edited) == key((r.doc_id, r.tokens_after, r.pretokens_encoded) for r in want)
    assert editcount.token_trees(docs.limit(0)).count() == 0 and editcount.edit_trees(trees.limit(0).withColumn("edits", F.lit(None))).count() == 0


def test_edit_query_counts(spark):
    rows = frame(spark, corpus())
    got = editcount.count_after_edits(rows.withColumn("edits", editcount.standard_edits())).collect()
    assert len(got) == len(corpus()) and all(r.pretokens_encoded < 80 for r in got)


def test_recompression_equals_brute_force(spark):
    for seed in (5, 6):
        rows = corpus(seed)
        got = recompress.repeats_digest(recompress.remove_repeats(frame(spark, rows))).collect()
        want = [(i, *x) for (i, _), x in zip(rows, recompress.brute_force([t for _, t in rows]), strict=True)]
        assert key(got) == key(want)
    assert recompress.remove_repeats(frame(spark, [])).count() == 0


def test_blocks_grow_with_the_square_root_of_the_input():
    sizes = [1 << 30, 1 << 40, 1 << 42, 1 << 44, 1 << 50, 1 << 62]
    assert [exchange.growth(n) for n in sizes] == [1, 1, 2, 4, 4, 1]


def test_interval_merge_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bwtmerge, "SHARD_BYTES", 3000)
    rows = corpus(8)
    got = bwtmerge.copies_digest(bwtmerge.remove_later_copies(frame(spark, rows))).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want = [(i, *x) for (i, _), x in zip(ordered, bwtmerge.brute_force([t for _, t in ordered]), strict=True)]
    assert key(got) == key(want)
    assert bwtmerge.remove_later_copies(frame(spark, [])).count() == 0


def test_chat_round_trip_and_layouts(spark):
    texts = ["\\### Assistant: </turn> ok", "####\\#\\", "</turn></turn>\n###", "", "a\nb"]
    turns = [{"role": r, "text": t} for t in texts for r in ("user", "assistant", "odd\nrole\\#")]
    line, mask = chat.render(turns)
    assert chat.parse(line) == turns
    assert [chat.unescape(line[a:b]) for a, b in mask] == texts
    rows = [{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 3}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"instruction": "q", "output": "a"}, {"prompt": "q", "completion": "a"}, {"question": "q", "answer": "a"}]
    data = [(i, json.dumps(x)) for i, x in enumerate(rows)] + [(10, None), (11, "{"), (12, '{"x": 1}')]
    got = {r.conv_id: r for r in chat.canonical_turns(spark.createDataFrame(data, "conv_id long, j string"), json_col="j").collect()}
    for i in range(len(rows)):
        assert [(t.role, t.text) for t in got[i].turns] == [("user", "q"), ("assistant", "a")]
    assert all(got[i].layout is None and got[i].turns is None for i in (10, 11, 12))
    by_row = spark.createDataFrame([(1, 2, "assistant", None), (1, 1, None, "x"), (None, 1, "user", "y")], "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.format_chat(chat.canonical_turns(by_row))).collect()}
    assert back[1].n_turns == 2 and back[1].loss_chars == 0 and back[None].n_turns == 1


def test_chat_layouts_with_further_fields(spark):
    qa = [("user", "q"), ("assistant", "a")]
    sys_qa = [("system", "s"), *qa]
    cases = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "prompt": "q"}, qa),
        ({"messages": []}, []),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}, {"type": "image", "url": "u"}]}, {"role": "bot", "content": ["a"]}]}, qa),
        ({"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, sys_qa),
        ({"instruction": "q", "input": "", "output": "a", "text": "all"}, qa),
        ({"instruction": "q", "input": "more", "output": "a", "system": "s"}, [("system", "s"), ("user", "q\n\nmore"), ("assistant", "a")]),
        ({"system": "s", "instruction": "q", "input": None, "output": "a"}, sys_qa),
        ({"prompt": "q", "completion": "a", "system": "s", "text": "all"}, sys_qa),
        ({"prompt": "q", "completion": "a", "response": "other"}, qa),
        ({"question": "q", "answer": None, "context": ""}, [("user", "q"), ("assistant", "")]),
        ({"messages": "none"}, None),
        ({"instruction": "q"}, None),
    ]
    for value, want in cases:
        _, turns = chat.turns_of(value)
        assert (turns if turns is None else [(t["role"], t["text"]) for t in turns]) == want, value
    rows = spark.createDataFrame([(1, 1, "user", "x", "p", "f", 3)], "conv_id long, turn long, role string, text string, prompt string, formatted string, messages int")
    done = chat.format_chat(chat.canonical_turns(rows).withColumn("formatted", F.lit("old")).withColumn("loss_spans", F.lit(1)).withColumn("more", F.lit(2)))
    assert done.columns == ["conv_id", "layout", "turns", "more", "formatted", "loss_spans"] and chat.read_back(done).first().n_turns == 1
    assert chat.read_back(chat.format_chat(chat.canonical_turns(rows.limit(0)))).count() == 0
    assert chat.canonical_turns(rows.limit(0), json_col="text").count() == 0


def test_html_rules():
    t = html.page_text("<title>no</title><p>a<p>b<ul><li>x<li>y<ol start=3><li>z</ol></ul><table><tr><td>aa<td>b<tr><th>c<td>ddd</table>t&amp;c<pre> x\n  y</pre><div style='display:none'>no</div><i hidden>no</i><script>no</script>end<br>last")
    assert t == "a\n\nb\n\n- x\n- y\n  3. z\n\naa | b\nc  | ddd\n\nt&c\n\n x\n  y\n\nend\nlast"
    assert html.page_text(None) == html.page_text("") == "" and html.page_text("<p") == "<p" and html.page_text("a  b") == "a b"
    assert html.page_text("<div>" * 5000 + "deep") == "deep"


def test_html_head_without_end_tag():
    assert html.page_text("<head><title>T</title>Hello <a href=x>link</a>") == "Hello link"
    assert html.page_text("<head><title>T</title><font size=2><p>a<p>b") == "a\n\nb"
    assert html.page_text("<html><head><meta x><li>one<li>two") == "- one\n- two"
    assert html.page_text("<head> <script>no</script> </head><body>x") == "x"
    assert html.page_text("a <svg><title>no</title><text>in</text></svg> <math>1</math> <textarea>t &amp; u</textarea><select><option>p<option>q</select>") == "a in 1 t & u\np\nq"


def test_html_cells_keep_lines_and_spans():
    t = html.page_text("<table><tr><td>a<ul><li>x<li>y</ul><td><pre>p\n  q</pre><tr><td colspan=2>wide cell here<tr><td rowspan=2>r<td>1<tr><td>2</table>")
    assert t.split("\n") == ["a   | p", "    |   q", "- x", "- y", "wide cell here", "r   | 1", "    | 2"]


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a '>", '<a ">" ', "<div>", "<div></p>", "<span><td></span>", "</x>", "<p><b>", "<li><i>", "<table><tr><td>", "<!--", "<script>", "<", "&amp"])
def test_html_time_grows_with_length(piece):
    import time

    began = time.process_time()
    html.page_text(piece * (400_000 // len(piece)))
    html.page_text("<div>" * 20_000 + piece * 20_000 + "</div></q>" * 20_000)
    assert time.process_time() - began < 8


def test_html_through_spark(spark):
    pages = spark.createDataFrame([(1, None, "old"), (2, "", "old"), (2, "<p>x", "old"), (2, "<p>x", "old")], "page_id long, html string, visible_text string")
    assert key(html.extract_text(pages).collect()) == key([(1, ""), (2, ""), (2, "x"), (2, "x")])
    assert html.extract_text(pages.limit(0)).count() == 0


def test_html_keeps_all_visible_characters(spark):
    from html.parser import HTMLParser

    class Visible(HTMLParser):
        def __init__(self):
            super().__init__()
            self.skip, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.visible_text for r in html.extract_text(pages).collect()}
    for p in pages.collect():
        v = Visible()
        v.feed(p.html)
        marks = str.maketrans("", "", " \t\n\r\f|-.0123456789")
        assert got[p.page_id].translate(marks) == "".join(v.out).translate(marks)


def test_contamination_equals_brute_force(spark, monkeypatch):
    rows = corpus(4)
    items = [("a", rows[45][1][10:400]), ("b", "One!"), ("c", None), ("d", "  "), ("b2", "x9 the")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows: dict = {}
    for i, t in items:
        w = decontaminate.normal(t).split()
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = []
    for doc, t in rows:
        w = decontaminate.normal(t).split()
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        want.append((doc, len(w), len(hit), len(found), decontaminate.sha256_hex(",".join(sorted(found)).encode()), bool(hit)))
    docs = frame(spark, rows)
    assert key(decontaminate.contamination_digest(decontaminate.find_contamination(docs, bench)).collect()) == key(want)
    whole = decontaminate.find_contamination(docs, bench)
    parts = decontaminate.find_contamination(docs, bench, max_pattern_bytes=100)
    assert key(decontaminate.contamination_digest(parts).collect()) == key(want)
    assert key(parts.select("doc_id", "spans").collect()) == key(whole.select("doc_id", "spans").collect())
    clean = decontaminate.find_contamination(docs.withColumn("spans", F.lit(1)), bench, keep_text=True, clean_only=True)
    assert key(clean.select("doc_id", "text").collect()) == key(r for r, w in zip(rows, want, strict=True) if not w[5])
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontaminate.find_contamination(docs, bench.limit(0)).collect()} == {0}


def test_each_benchmark_of_a_session_has_its_own_matcher(spark):
    docs = spark.createDataFrame([(i, f"zero word{i} one two") for i in range(40)], "doc_id long, text string").repartition(4)
    for i in range(20):
        bench = spark.createDataFrame([(f"q{i}", f"word{i} one"), ("r", f"word{i + 15}")], "item_id string, text string")
        got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.find_contamination(docs, bench).collect() if r.n_hit}
        assert got == {i: (2, [f"q{i}"]), i + 15: (1, ["r"])}


def test_long_texts_are_scanned_across_slices(spark):
    words = [f"w{i}" for i in range(400_000)]
    item = " ".join(words[i] for i in range(190_000, 190_040))
    n, runs, items = decontaminate.Matcher([("a", item.encode())], 10).find(" ".join(words).encode())
    assert (n, runs, items) == (400_000, [[190_000, 190_040]], {"a"})
    assert sum(len(x.split()) for x in decontaminate.slices(" ".join(words).encode(), 1000)) == 400_000
    assert toxicity.word_counts(" ".join(words + words))["w7".encode()] == 2


def test_spans_are_offsets_of_the_original(spark):
    text = "É Ünd: ONE two-three FOUR five six; seven eight NINE ten! tail"
    bench = spark.createDataFrame([("q", "one two three four five six seven eight nine ten")], "item_id string, text string")
    r = decontaminate.find_contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench).first()
    assert [text.encode()[s.start : s.end].decode() for s in r.spans] == ["ONE two-three FOUR five six; seven eight NINE ten"]


def toxic_rows():
    rng = random.Random(11)
    bad = ["vile", "rotten", "nasty"]
    out = []
    for i in range(600):
        t = prose(rng, 60).split()
        y = i % 4 == 0
        if y:
            for _ in range(4):
                t.insert(rng.randint(0, len(t)), rng.choice(bad))
        out.append((i, " ".join(t), int(y)))
    return out


def test_neighbours_are_exact_and_held_out_accuracy(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, ""), (9002, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, max_examples=300)
    got = toxicity.score_documents(docs, model).withColumn("h", toxicity.held_out()).collect()
    truth = {i: y for i, _, y in rows}
    held = [(truth[r.doc_id], r.score) for r in got if r.h and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got if r.h) and len(held) > 80
    assert np.mean([(s >= 0.5) == bool(y) for y, s in held]) > 0.9
    assert all(abs(r.score - model.prior) < 1e-9 for r in got if r.doc_id > 9000)
    text, ix = {i: t for i, t, _ in rows}, model.index
    idf = dict(zip(sorted(ix.words), ix.word_idf, strict=True))

    def vector(t):
        v = {w: (1 + np.log(c)) * idf[w] for w, c in toxicity.word_counts(t).items() if w in idf}
        n = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / n for w, x in v.items()}

    vectors = [vector(text[i]) for i in ix.ids.tolist()]
    for r in got:
        q = vector(text.get(r.doc_id))
        best = sorted((sum(x * v.get(w, 0) for w, x in q.items()) for v in vectors), reverse=True)[: model.k]
        assert np.allclose([e.cosine for e in r.evidence], [x for x in best if x > 0])
    kept = toxicity.score_documents(docs, model, keep_text=True, evidence=False, clean_only=True)
    assert kept.columns == ["doc_id", "text", "score", "predicted"]
    assert key(kept.collect()) == key((r.doc_id, text.get(r.doc_id, "" if r.doc_id == 9001 else None), r.score, 0) for r in got if not r.predicted)


def test_few_toxic_words_in_long_texts_are_caught(spark):
    rng = random.Random(41)
    own, bad = [f"k{i}" for i in range(4000)], [f"vile{i}" for i in range(10)]
    rows = []
    for i in range(900):
        words = [rng.choice(own) for _ in range(150)]
        rows.append((i, " ".join(words + rng.sample(bad, 2) * (i % 8 == 0)), int(i % 8 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    got = toxicity.score_documents(docs, model).where(toxicity.held_out()).collect()
    assert np.mean([r.predicted for r in got if r.doc_id % 8 == 0]) > 0.9
    assert np.mean([r.predicted for r in got if r.doc_id % 8]) < 0.02


def test_block_bounds_keep_most_blocks_shut():
    """Examples of twelve subjects: exact neighbours from few of the blocks."""
    rng = random.Random(21)
    texts = [" ".join(rng.choice(WORDS) if rng.random() < 0.4 else f"s{i % 12}w{rng.randint(0, 80)}" for _ in range(60)) for i in range(900)]
    counts = [toxicity.word_counts(t) for t in texts]
    df: dict = {}
    for c in counts:
        for w in c:
            df[w] = df.get(w, 0) + 1
    index = toxicity.Index([(i, i % 2, c) for i, c in enumerate(counts[:600])], df, 900)
    idf = dict(zip(index.words, index.word_idf, strict=True))

    def unit(c):
        v = {w: (1 + np.log(n)) * idf[w] for w, n in c.items()}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors = [unit(counts[i]) for i in index.ids.tolist()]
    for c, (_, cosines) in zip(counts[600:], index.nearest(counts[600:], 31), strict=True):
        q = unit(c)
        assert np.allclose(cosines, sorted((sum(x * v.get(w, 0) for w, x in q.items()) for v in vectors), reverse=True)[:31])
    assert index.opened < 0.35 * index.offered


def test_toxicity_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, toxicity.fit(docs, labels)).collect()
    assert [(r.score, r.predicted, r.evidence) for r in got] == [(0.0, 0, [])] * 2
    assert toxicity.score_documents(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0
    clash = docs.selectExpr("*", "'x' AS score", "7 AS _text", "text AS words")
    assert toxicity.score_documents(clash, toxicity.fit(docs, labels)).columns == ["doc_id", "words", "score", "predicted", "evidence"]


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_jaccard_equals_brute_force(spark, words, percent):
    rows = corpus(9)
    got = jaccard.jaccard_components(frame(spark, rows), words=words, percent=percent).collect()
    assert key(got) == key(jaccard.brute_force(rows, words, percent))
    assert jaccard.jaccard_components(frame(spark, [])).count() == 0


def test_jaccard_links_across_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", 2)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(25):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(120)] = f"e{rng.randint(0, 3)}"
        rows.append((i, " ".join(w)))
    assert key(jaccard.jaccard_components(frame(spark, rows)).collect()) == key(jaccard.brute_force(rows))


def test_jaccard_large_group_of_many_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", 24)
    rng = random.Random(5)
    rows = []
    for i in range(300):
        w = [f"w{j}" for j in range(110)]
        for _ in range(rng.choice([0, 1, 2, 3, 4, 4, 5, 5, 6, 6])):
            w[rng.randrange(110)] = f"e{rng.randint(0, 2)}"
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    want = jaccard.brute_force(rows)
    assert len({c for _, _, c in want}) > 100
    assert key(jaccard.jaccard_components(frame(spark, rows)).collect()) == key(want)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(60, 32))
    rows = [(i, (centre[i % 60] + rng.normal(size=32) * 0.12).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(5)] + [(2000, None), (2001, []), (2002, [0.0] * 32), (2003, [None] * 32), (2004, [float("nan")] * 32), (2005, [1.0, 2.0]), (None, rows[7][1])]
    got = itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    ok = [(i, v) for i, v in rows if v and len(v) == 32 and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.array([v for _, v in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    found = sum(r.n_links for r in got)
    assert len(got) == len(rows) and 0.99 * near.sum() <= found <= near.sum()
    assert all(r.n_links == 0 and r.kept for r in got if r.vec_id is not None and 2000 <= r.vec_id <= 2005)
    assert {r.component_id for r in got if r.vec_id is None} == {r.component_id for r in got if r.vec_id == 7}


def test_vectors_of_rarer_lengths_link(spark):
    """Two lengths with learned codes, one of few vectors: as brute force over each length."""
    rng = np.random.default_rng(6)
    rows = []
    for size, n in ((32, 900), (24, 600), (16, 40)):
        centre = rng.normal(size=(n // 4, size))
        rows += [(len(rows) + i, (centre[i % len(centre)] + rng.normal(size=size) * 0.12).tolist()) for i in range(n)]
    copies = rng.normal(size=24).tolist()
    rows += [(5000, copies), (5001, copies), (5002, [1.0, 2.0]), (5003, [1.01, 2.0]), (5004, [1.0, -2.0])]
    got = {r.vec_id: r for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
    assert len(got) == len(rows)
    for size in (32, 24, 16):
        own = [(i, v) for i, v in rows if len(v) == size]
        x = np.array([v for _, v in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        want = int((x @ x.T >= 0.95).sum()) - len(own)
        assert want > 0 and 0.99 * want <= sum(got[i].n_links for i, _ in own) <= want
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(5000, 5005)] == [(1, 5000, True), (1, 5000, False), (1, 5002, True), (1, 5002, False), (0, 5004, True)]


@pytest.mark.parametrize(("common", "nodes"), [(0.0, 20_000), (0.8, 1_000_000), (0.94, 20_000)])
def test_codes_find_pairs_of_off_centre_vectors(common, nodes):
    """Any two vectors have a cosine of about `common`, planted pairs one of 0.955."""
    rng = np.random.default_rng(4)
    way = rng.normal(size=(4000, 64)) * (np.arange(64) > 0)
    unit = np.sqrt(common) * np.eye(64)[0] + np.sqrt(1 - common) * way / np.linalg.norm(way, axis=1, keepdims=True)
    turn = rng.normal(size=unit.shape)
    turn -= (turn * unit).sum(1, keepdims=True) * unit
    pairs = 0.955 * unit + np.sqrt(1 - 0.955**2) * turn / np.linalg.norm(turn, axis=1, keepdims=True)
    codes = itq.Codes(unit[:2000], nodes, 0.95)
    found = (codes(unit) == codes(pairs)).any(1) & ((codes.signs(unit) != codes.signs(pairs)).sum(1) <= codes.radius)
    assert found.mean() >= 0.998


def test_vectors_without_rows_and_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], "x", 3), (1, [1.0, 2.0], "x", 3), (None, None, "x", 3)], "vec_id long, embedding array<double>, node string, code int")
    assert itq.near_duplicates(rows.limit(0)).count() == 0
    assert key(itq.near_duplicates(rows).collect()) == key([(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)])


def test_few_vectors_are_sent_to_be_reranked(spark, monkeypatch):
    """Of unrelated vectors and some pairs, the pairs alone have a code within the radius."""
    kept = []
    real = itq.written
    monkeypatch.setattr(itq, "written", lambda df, name: (lambda out: kept.append(out.select("node").distinct().count()) or out if name == "near" else out)(real(df, name)))
    rng = np.random.default_rng(12)
    x = rng.normal(size=(4000, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, (x[i] + 0.05 * rng.normal(size=64)).tolist()) for i in range(50)]
    got = {r.vec_id: r for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i].n_links == 1 and got[5000 + i].component_id == i for i in range(50)) and sum(r.n_links for r in got.values()) == 100
    assert 100 <= kept[0] < 1000


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    a = p.drop_toxic(spark, docs, d)
    assert a.columns == docs.columns and 0.8 * docs.count() < a.count() <= docs.count()
    b = p.drop_near_copies(spark, docs, d)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(i for i, _, c in jaccard.brute_force(rows, 5, 80) if i == c)
    assert sorted(r.doc_id for r in b.collect()) == want
    c = {r.doc_id: r.text for r in p.drop_repeats(spark, docs, d).collect()}
    for (i, t), (n, gone, _) in zip(rows, recompress.brute_force([t for _, t in rows]), strict=True):
        assert (i not in c) if gone and gone == n else (c[i] == t if not gone else len(c[i].split()) == n - gone)
    e = p.drop_contaminated(spark, docs, d)
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{d}/benchmark.parquet")).where("n_hit = 0")
    assert sorted(r.doc_id for r in e.collect()) == sorted(r.doc_id for r in found.collect())


def pipeline_rows():
    """Documents with toxic ones, near copies, a shared passage, benchmark text, odd rows; labels; benchmark."""
    rng = random.Random(31)
    own = [f"k{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(own) for _ in range(n))
    docs, labels, item, passage = [], [], text(14), text(60)
    for i in range(240):
        words = text(70).split()
        if i % 6 == 0:
            for _ in range(6):
                words.insert(rng.randint(0, len(words)), rng.choice(["vile", "rotten", "nasty"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    docs += [(1000 + i, f"{text(50)} {passage} {text(30)}") for i in range(4)]
    docs += [(1100 + i, f"{text(40)} {item} {text(40)}") for i in range(3)]
    base = text(90)
    docs += [(1200 + i, base + f" tail{i}") for i in range(5)] + [(1300, "word"), (1301, ""), (1302, None), (1303, None), (None, text(20)), (1, text(80)), (1304, text(40)), (1304, text(40))]
    twin = text(60)
    docs += [(1400, twin), (1400, twin), (1401, text(20_000))]
    return docs, labels, [("q", item), ("empty", ""), (None, None)]


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline as p

    docs, labels, bench = pipeline_rows()
    d = str(tmp_path)
    frame_of = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame_of.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    table = spark.read.parquet(f"{d}/documents.parquet")
    # Toxicity by all pairs: cosines over the examples' words, the 31 nearest, the fitted curve.
    model = toxicity.fit(table, spark.read.parquet(f"{d}/labels.parquet"))
    ix, texts = model.index, {}
    for i, t in docs:
        texts[i] = min(x for j, x in docs if j == i and x is not None) if t is not None else texts.get(i)
    idf = {}
    counts = [toxicity.word_counts(t) for _, t in docs]
    for w in ix.words:
        idf[w] = float(np.log((1 + len(docs)) / (1 + sum(w in c for c in counts))) + 1)

    def unit(c):
        v = {w: (1 + np.log(n)) * idf[w] for w, n in c.items() if w in idf}
        size = np.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / size for w, x in v.items()}

    examples = [unit(toxicity.word_counts(texts[i])) for i in ix.ids.tolist()]
    kept = []
    for (i, t), c in zip(docs, counts, strict=True):
        q = unit(c)
        cosine = np.round([sum(x * e.get(w, 0.0) for w, x in q.items()) for e in examples], 12)
        best = [j for j in np.lexsort((np.arange(len(cosine)), -cosine))[: model.k] if cosine[j] > 0]
        if best:
            w = 1 / (1 - np.minimum(cosine[best], 1) + toxicity.NEAREST)
            vote = (w * ix.labels[best]).sum() / w.sum()
            score = 1 / (1 + np.exp(-(model.a * vote + model.b)))
        else:
            score = sum(y for j, y in labels if zlib.crc32(str(j).encode()) % 5) / sum(1 for j, _ in labels if zlib.crc32(str(j).encode()) % 5)
        if score < 0.5:
            kept.append((i, t))
    gone = {i for i, _ in docs} - {i for i, _ in kept}
    assert gone and all(i % 6 == 0 for i in gone)
    got = p.drop_toxic(spark, table, d)
    assert key(got.select("doc_id", "text").collect()) == key(kept)
    # One of each component, then repeats, then windows of the benchmark, then packing: each piece of each kept text.
    hashes = {(r.doc_id, r.text): r.h for r in table.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    components: dict = {}
    n = len(kept)
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in kept]
    up = list(range(n))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(n):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    for k, row in enumerate(kept):
        components.setdefault(top(k), []).append(row)
    kept = list({min(rows, key=lambda r: (r[0] is None, r[0] or 0, hashes[r])) for rows in components.values()})
    stage = p.drop_near_copies(spark, got, d)
    assert key(stage.select("doc_id", "text").collect()) == key(kept) and (1, docs[1][1]) in kept
    done = []
    for (i, t), (words, removed, _) in zip(kept, recompress.brute_force([t for _, t in kept]), strict=True):
        done.append((i, t, words, removed))
    seen: dict = {}
    for _, t, *_ in done:
        w = (t or "").split()
        for k in range(len(w) - 34):
            seen[tuple(w[k : k + 35])] = seen.get(tuple(w[k : k + 35]), 0) + 1
    kept = []
    for i, t, words, removed in done:
        w, mark = (t or "").split(), [False] * words
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                mark[k : k + 35] = [True] * 35
        if not removed or removed < words:
            kept.append((i, " ".join(x for x, m in zip(w, mark, strict=True) if not m) if removed else t))
    assert sum(removed for *_, removed in done) >= 4 * 60
    stage = p.drop_repeats(spark, stage, d)
    assert key(stage.select("doc_id", "text").collect()) == key(kept)
    assert all(r.n_chars == len(r.text or "") for r in stage.collect())
    item = tuple(decontaminate.normal(bench[0][1]).split())
    windows = {item[k : k + 10] for k in range(len(item) - 9)}
    clean = []
    for i, t in kept:
        w = decontaminate.normal(t).split()
        if not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9)):
            clean.append((i, t))
    assert len(kept) - len(clean) == 3
    e = tokens.encoder(tokens.default_tokenizer())
    want = sorted((str(i), len(e.whole(t or "")) // 4 + 1) for i, t in clean)
    by: dict = {}
    packed = p.run(spark, d).collect()
    for r in packed:
        by.setdefault((str(r.doc_id), r.doc_tokens), []).append(r)
    total = sorted((i, n) for i, n in by for _ in range(sum(x.length for x in by[i, n]) // n))
    assert total == want


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """No rows, no labels, no benchmark, and further columns with the names that operators add."""
    import corpus_pipeline as p

    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    names = ["score", "predicted", "_text", "n_words", "n_removed", "kept_text", "n_hit", "spans", "items", "_found", "key", "kept", "node"]
    rows = [(i, t) for i, t in corpus(3)]
    docs = spark.createDataFrame([(i, t, "en", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, n_chars long").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and out.count() > 0
        assert out.where("doc_id IS NOT NULL AND NOT (" + " AND ".join(f"{c} = concat('{c}', doc_id)" for c in names) + ")").count() == 0
        assert stage(spark, docs.limit(0), d).count() == 0
    assert p.drop_toxic(spark, docs, d).count() == p.drop_contaminated(spark, docs, d).count() == docs.count()
    assert p.pack(spark, docs.limit(0), d).count() == 0


def test_merged_transforms_give_the_same_copies(spark, monkeypatch):
    """The published merge, brute force and the operator agree."""
    rng = random.Random(3)
    for per_shard in (1, 7, 100):
        texts = [t.encode() for _, t in sorted((i, t or "") for i, t in corpus(8) if i is not None)][:60]
        texts = [t[:900] for t in texts] + [bytes(rng.choice(b"ab") for _ in range(200)) for _ in range(3)]
        for window in (12, 100):
            gone = interleave.later_copies(texts, window, per_shard)
            want = bwtmerge.brute_force([t.decode() for t in texts], window) if all(len(t.decode(errors="ignore").encode()) == len(t) for t in texts) else None
            seen: set = set()
            for t, g in zip(texts, gone, strict=True):
                mark = np.zeros(len(t), bool)
                for i in range(len(t) - window + 1):
                    if t[i : i + window] in seen:
                        mark[i : i + window] = True
                    seen.add(t[i : i + window])
                assert (mark == g).all()
            assert want is None or [w[1] for w in want] == [int(g.sum()) for g in gone]
