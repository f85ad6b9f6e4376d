"""Each operator against brute force on small fixtures with nulls, empty and long texts, ties, repeated rows, no rows and clashing columns."""

import os
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import bpe, chat, exact_search, html, jaccard, lines, near_search, packing, secrets, shared, toxicity
from palisade.llm.vocabulary import json_tokenizer, public, rank_encoding

RANKS, WORDS = public("byte_bpe_50k.tiktoken"), public("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, spans string, ids string"
LONG = " ".join(f"w{i % 977}é" for i in range(6000))
TEXTS = [None, "", " ", "a  b\n\n c\t d", "Ab it's 42 x    y", LONG, LONG + " end", "one two three four five six", "one two three four five six", "\n".join(["same line here for all", "own line %d"]), "same line here, for ALL\nother"]


def documents(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, None, "s", 0, i, 0.5, "x", "y") for i, t in enumerate(texts)], SCHEMA)


def test_bpe(spark):
    docs = documents(spark)
    rows = {r["doc_id"]: r for r in bpe.encode(docs.unionByName(docs.where("doc_id = 5")), RANKS, 5000).collect()}
    for i, text in enumerate(TEXTS):
        ids = np.array(rank_encoding(RANKS).encode_ordinary(text or ""), "<u4")
        assert bytes(rows[i]["ids"]) == ids.tobytes() and bytes(rows[i]["decoded"]).decode() == (text or "")
    assert bpe.encode(documents(spark, []), RANKS).count() == 0


def test_packing(spark):
    docs = documents(spark)
    rows = packing.pack_documents(docs.unionByName(docs.where("doc_id = 7")), WORDS).collect()
    for i, text in enumerate(TEXTS):
        ids = np.array(json_tokenizer(WORDS).encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for r in (r for r in rows if r["doc_id"] == i):
            own = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(own.tobytes()) and list(own) == r["ids"] and r["piece"] * 2048 == r["start"]
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(documents(spark, []), WORDS).count() == 0


def test_plan_places_all():
    random.seed(5)
    for _ in range(20):
        histogram = {random.randint(1, 100): random.randint(1, 400) for _ in range(random.randint(0, 30))}
        placed = {}
        for pattern, times in packing.plan(histogram, 100, 30):
            assert sum(x * n for x, n in pattern.items()) <= 100
            for x, n in pattern.items():
                placed[x] = placed.get(x, 0) + n * times
        assert placed == histogram


def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(16)], 0) for i in range(600)] + [(i, [1.0] * 16, 0) for i in range(600, 640)]
    rows += [(640, None, 0), (641, [None] * 16, 0), (642, [float("nan")] * 16, 0), (643, [float("inf")] * 16, 0), (644, [0.0] * 16, 0), (645, [], 0), (646, [1.0, 2.0], 0), (None, [1.0] * 16, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"), rows


def test_exact_search(spark):
    df, rows = vectors(spark)
    found = exact_search.top_k(df, df.where("vec_id % 50 = 0"), k=7, stripe_rows=200, block_rows=8).collect()
    usable = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    for q in range(0, 640, 50):
        best = sorted((-int(x @ usable[q]), i) for i, x in usable.items() if i != q and len(x) == 16)[:7]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == [(i, -s) for s, i in best]
    assert exact_search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_near_search(spark):
    df, rows = vectors(spark)
    found = near_search.nearest(df, df.where("vec_id % 20 = 0"), k=10, stripe_rows=300, block_rows=16).collect()
    usable = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    hit = total = 0
    for q in range(0, 640, 20):
        best = {i for _, i in sorted((-float((x * usable[q]).sum()), i) for i, x in usable.items() if i != q and len(x) == 16)[:10]}
        own = {r["vec_id"] for r in found if r["query_id"] == q}
        hit, total = hit + len(best & own), total + 10
    assert hit >= 0.9 * total
    assert near_search.nearest(df.limit(0), df.limit(0)).count() == 0


def components_of(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_jaccard(spark):
    random.seed(2)
    base = [f"k{i}" for i in range(60)]
    texts = list(TEXTS)
    for _ in range(60):
        own = list(base)
        for _ in range(random.randint(0, 3)):
            own[random.randrange(60)] = f"z{random.randrange(9)}"
        texts.append(" ".join(own))

    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    wanted = components_of(len(sets), links)
    for r in jaccard.jaccard_components(documents(spark, texts), 4, 85).collect():
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), wanted[r["doc_id"]])
    assert jaccard.jaccard_components(documents(spark, [])).count() == 0


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = [new := i + 1] + [new := min(new + 1, row[j + 1] + 1, row[j] + (x != y)) for j, y in enumerate(b)]
        return row[-1]

    random.seed(4)
    for _ in range(2000):
        a, b = ("".join(random.choices("abc", k=random.randint(0, 9))) for _ in range(2))
        assert lines.edit_distance(a, b) == plain(a, b)


def test_lines(spark):
    docs = documents(spark)
    rows = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    assert rows[0]["text"] is None and rows[1]["text"] == "" and rows[1]["n_lines"] == 0
    assert rows[8]["text"] == "" and rows[8]["n_removed"] == 1 and rows[7]["n_removed"] == 0
    assert rows[10]["text"] == "other" and rows[9]["n_removed"] == 0
    assert set(docs.columns) <= set(lines.dedup_lines(docs).columns)
    assert lines.dedup_lines(documents(spark, [])).count() == 0


def test_secrets(spark):
    texts = ["x password=abcdefgh1 y", "token: short", "AKIA" + "Q" * 12, "a" * 32, None, "", "id 123e4567-e89b-12d3-a456-426614174000", "key Zx9Qw7Lk2Vb5Nm8Tr4Yp6", "Secret = 'abcdefgh'"]
    rows = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan(documents(spark, texts), RANKS).collect()}
    assert rows == {0: [("assign", 2, 20)], 1: [], 2: [("access", 0, 16)], 3: [("hex", 0, 32)], 4: [], 5: [], 6: [], 7: [("random", 4, 25)], 8: [("assign", 0, 18)]}
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(documents(spark, texts), RANKS).collect()}
    assert masked[0] == "x [secret] y" and masked[4] is None and masked[5] == ""


def test_toxicity(spark):
    random.seed(6)
    words = [a + b for a in ("ba", "ne", "ti", "sor", "la") for b in ("ra", "mo", "li", "den", "su")]
    texts, marks = [], []
    for i in range(600):
        own = random.choices(words, k=40)
        if i % 3 == 0:
            own[5] = "grumf" + random.choice(["ra", "mo", "li"])
        texts.append(" ".join(own))
        marks.append(int(i % 3 == 0))
    labels = spark.createDataFrame([(i, m, None) for i, m in enumerate(marks)] + [(None, 1, None), (3, None, None)], "doc_id long, toxic int, text string")
    rows = toxicity.classify(documents(spark, texts + [None, "", "..."]), labels).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 600]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum((r["score"] >= 0.7) == bool(marks[r["doc_id"]]) for r in held) >= 0.95 * len(held)
    assert [r["score"] for r in rows if r["doc_id"] >= 600] == [0.0] * 3
    assert toxicity.classify(documents(spark, []), labels.limit(0)).count() == 0


def test_html(spark):
    page = "<title>t</title><nav>n</nav><article><h1>A &amp; B</h1><p>x <b>y</b>\n z<p>q<div class='comments'><p>c</p></div><form>f</form><ul><li>i</ul></article><footer>e</footer>"
    rows = [(1, "http://a.org/1", page, "x"), (2, None, None, "x"), (3, "http://a.org/3", "", "x"), (4, "http://a.org/4", "<p>un<br>closed <i>text", "x")]
    found = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert found == {1: "A & B\nx y z\nq\ni", 2: "", 3: "", 4: "un closed text"}


def test_style_tree(spark):
    rows = [(i, f"http://b.org/{i}", f"<div><p>own text {i}</p></div><section><p>the same on every page</p></section>") for i in range(20)]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"own text {r['page_id']}" for r in found)


def test_chats(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], "short?" if t % 2 == 0 else "a much longer answer " * 20) for c in range(40) for t in range(6)]
    rows += [(99, 0, None, "User: hello\nAssistant: hi\nthere"), (100, 0, None, None), (101, 0, "other", "")]
    found = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    own = sorted((r["segment"], r["role"], r["text"]) for r in found if r["conv_id"] == 99)
    assert own == [(0, "user", "hello"), (1, "assistant", "hi\nthere")]
    known = [r for r in found if r["conv_id"] < 40]
    assert sum(r["role"] == ("user", "assistant")[r["turn"] % 2] for r in known) == len(known) == 240


def test_long_chat_is_decoded_in_chunks(spark, monkeypatch):
    rows = [(1, t, ("user", "assistant")[t % 2], f"q{t}?" if t % 2 == 0 else f"answer {t} " * 20) for t in range(700)]
    found = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(found) == 700 and all(r["role"] == ("user", "assistant")[r["turn"] % 2] for r in found)


def test_queries_are_registered():
    import __spark_entry__ as E

    assert sorted({q.split("_")[0] for q in E.queries() if q.startswith("op")}) == sorted(f"op{i}" for i in range(1, 11)) and "pipeline" in E.queries()


def test_scores_beyond_single_products(spark):
    rows = [(0, [1.5e6, -1e6]), (1, [1e6, 1.0]), (2, [-1.5e6, 5e5]), (3, [0.001, -0.001])]
    found = exact_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>"), k=3).collect()
    ints = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    wanted = sorted((-sum(a * b for a, b in zip(ints[0], ints[i], strict=True)), i) for i in (1, 2, 3))
    assert [(-r["score"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"])] == wanted
    with pytest.raises(OverflowError):
        exact_search.products(np.array([[2**40]]), np.array([2**30]))


def test_secrets_in_long_texts():
    encode = rank_encoding(RANKS).encode_ordinary
    began = time.time()
    assert [k for k, *_ in secrets.find_spans("ab-" * 30000 + "=", encode, 1.9)] in ([], ["random"])
    assert len(secrets.find_spans(" ".join(f"password=abcdefgh{i}" for i in range(8000)), encode, 1.9)) == 8000
    assert len(secrets.find_spans("x" * 99_999 + "1", encode, 1.9)) <= 1
    assert secrets.find_spans("a" * 35 + "-" + "b" * 35 + "1=", encode, 1.9) is not None
    assert time.time() - began < 10
    # A random string that a base span overlaps isn't told of again.
    assert [k for k, *_ in secrets.find_spans("token=QzXwKpLmNbVcRtYuIoPaSdFgHj", encode, 1.9)] == ["assign"]


def plain_viterbi(model, seen):
    best, back = None, []
    for x in seen:
        step = model.new_step(x)
        total = step[[-1]] if best is None else best[:, None] + step[:-1]
        back.append(total.argmax(axis=0))
        best = total.max(axis=0)
    state, out = int(best.argmax()), []
    for b in reversed(back):
        out.append(state)
        state = int(b[state])
    return out[::-1]


def test_chats_as_by_plain_viterbi(spark):
    random.seed(3)
    rows = []
    for c in range(30):
        for t in range(random.choice([1, 4, 300])):
            role = chat.ROLES[1 + t % 2] if t else "system"
            text = {"system": "be brief", "user": "what is it?", "assistant": "- one\n- two\nUser: three"}[role] * random.randint(1, 2)
            rows.append((c, t, role, text))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.learn(chat.laid(df).cache())
    found = {}
    for r in chat.format_chats(df).orderBy("conv_id", "turn", "segment").collect():
        found.setdefault((r["conv_id"], r["turn"]), []).append(r["role"])
    for c in range(30):
        own = [x for x in rows if x[0] == c]
        seen = [chat.features(line, place, t == 0 and place == 0) for _, t, _, text in own for place, line in enumerate(text.split("\n"))]
        states = iter(plain_viterbi(model, seen))
        for _, t, _, text in own:
            lines_ = [next(states) for _ in text.split("\n")]
            assert found[c, t] == [chat.ROLES[x] for i, x in enumerate(lines_) if not i or lines_[i - 1] != x]


def test_markers_that_are_text(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], "short?" if t % 2 == 0 else "a much longer answer " * 20) for c in range(400) for t in range(6)]
    rows += [(9999, 0, "user", "User: is it so?\nAssistant: yes"), (9998, 0, None, None)]
    found = chat.format_chats(spark.createDataFrame(rows + rows[-1:], "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("x"))).collect()
    assert [(r["role"], r["text"]) for r in sorted(found, key=lambda r: r["segment"]) if r["conv_id"] == 9999] == [("user", "is it so?"), ("assistant", "yes")]
    assert len([r for r in found if r["conv_id"] == 9998]) == 2
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_words_hide_no_article_text(spark):
    """Articles whose own classes hold words of the list, over several templates."""
    frames = [
        "<body class='has-sidebar'><div class='menu'>m {0}</div><article class='notice-board'><h2>T {0}</h2><p>body {0}</p></article><div class='sidebar'>s</div></body>",
        "<body><div id='nav'>n</div><main class='comments-closed'><p>T {0}</p><p>body {0}</p></main><footer>f</footer></body>",
        "<body><div class='wrap'><header>h</header><article><p>T {0}</p><p>body {0}</p><aside>a</aside></article></div></body>",
    ]
    rows = [(n * 100 + i, f"http://t{n}.org/{i}", frame.format(i)) for n, frame in enumerate(frames) for i in range(30)] + [(900, "http://t0.org/x", ""), (901, "http://t0.org/y", None)]
    found = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {n * 100 + i: f"T {i}\nbody {i}" for n in range(3) for i in range(30)} | {900: "", 901: ""}
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_lines_that_repeat(spark):
    docs = documents(spark, ["a b c\na b c\n--\n--\nd", "A, b; c!\nd\n\n", "x " * 50_000, "x " * 50_000 + "\ny"])
    rows = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in lines.dedup_lines(docs.unionByName(docs.where("doc_id = 1"))).collect()}
    assert rows[0] == ("a b c\n--\n--\nd", 5, 1) and rows[1] == ("\n", 4, 2) and rows[3] == ("y", 2, 1) and rows[2][2] == 0


def test_pipeline_against_its_stages_by_hand(spark, tmp_path):
    """Small texts through all five stages, and what plain Python makes of them."""
    import corpus_pipeline

    random.seed(12)
    syllables = [a + b for a in ("ba", "ne", "ti", "sor", "la", "gu") for b in ("ra", "mo", "li", "den", "su")]
    words = [x + y for x in syllables for y in syllables]
    texts = []
    for i in range(240):
        own = random.choices(words, k=60)
        if i % 4 == 0:
            own[7] = "grumf" + random.choice(["ra", "mo", "li"])
        texts.append("\n".join(" ".join(own[a : a + 12]) for a in range(0, 60, 12)))
    clean = [i for i in range(240) if i % 4]
    extra = [texts[clean[0]].replace("\n", " "), "shared line of some words here\n" + " ".join(random.choices(words, k=40)), "Shared line, of some words here\n" + " ".join(random.choices(words, k=40)), "password=abcdefgh1 " + " ".join(random.choices(words, k=40)), None, ""]
    texts += extra
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, str(tmp_path)).cache()
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids >= set(range(240, 246)) and len(ids & set(clean)) >= 0.97 * len(clean) and len(ids & {i for i in range(240) if i % 4 == 0}) <= 4
    deduped = {r["doc_id"]: r["text"] for r in stages["line dedup"](spark, kept, str(tmp_path)).collect()}
    assert deduped[241] == texts[241] and deduped[242] == texts[242].split("\n")[1] and deduped[244] is None and set(deduped) == ids
    near = {r["doc_id"] for r in stages["n-gram Jaccard join"](spark, kept, str(tmp_path)).collect()}
    assert near == ids - {240}
    masked = {r["doc_id"]: r["text"] for r in stages["secret scans"](spark, kept, str(tmp_path)).collect()}
    assert masked[243] == texts[243].replace("password=abcdefgh1", "[secret]") and masked[0 if 0 in masked else 1] == texts[0 if 0 in masked else 1]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = {}
    for r in packed:
        sizes.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = sum(r["length"] for r in packed)
    assert {r["doc_id"] for r in packed} == ids - {240} and len(sizes) == -(-total // 2048)
    assert all(a + n == b for own in sizes.values() for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:], strict=False))


def test_word_ids_equal_those_of_whole_texts():
    texts = [None, "", " \x1f ", "a\x1cb \x02x y\x02 <|endoftext|>z\x85q \x02", "ab\x02\x02c d é́ <|startoftext|>", "ΟΔΟΣ İx ﬁ 'S o's \x02's 't", "plain words, plain"]
    tokenizer = json_tokenizer(WORDS)
    known = packing.WordIds(tokenizer)
    for _ in range(2):
        for text, ids in zip(texts, known.of([packing.words_of(x) for x in texts]), strict=True):
            assert tokenizer.encode(text or "", add_special_tokens=False).ids == ids.tolist()


def test_lines_with_a_changed_word(spark):
    random.seed(8)
    words = [a + b + c for a in ("ba", "ne", "ti", "sor") for b in ("ra", "mo", "li", "den") for c in ("k", "s", "lt", "ve")]
    base = [random.choices(words, k=30) for _ in range(60)]
    near = [own[:9] + ["zz"] + own[10:] for own in base]
    docs = documents(spark, [" ".join(x) for x in base + near])
    removed = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(docs).collect()}
    # All lines with one changed word of 30 are found, and no strangers.
    assert [removed[i] for i in range(120)] == [0] * 60 + [1] * 60


def test_edited_lines_meet_as_in_brute_force(spark):
    # Lines of 4 to 60 words with up to a tenth of the words changed, added or left out, held against all pairs.
    random.seed(9)
    words = [a + b + c for a in ("ba", "ne", "ti", "sor") for b in ("ra", "mo", "li", "den") for c in ("k", "s", "lt", "ve")]
    texts = []
    for _ in range(80):
        base = random.choices(words, k=random.randint(4, 60))
        texts.append(" ".join(base))
        for _ in range(2):
            own = list(base)
            for _ in range(random.randint(0, len(own) // 10)):
                at = random.randrange(len(own))
                own[at : at + 1] = random.choice([[], [random.choice(words)], [own[at], random.choice(words)]])
            texts.append(" ".join(own))
    similar = [(a, b) for a in range(len(texts)) for b in range(a) if abs(len(texts[a]) - len(texts[b])) * 5 <= 300 and len(set(texts[a].split()) & set(texts[b].split())) > 1 and 5 * lines.edit_distance(texts[a], texts[b]) <= max(map(len, (texts[a], texts[b])))]
    wanted = components_of(len(texts), similar)
    removed = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(documents(spark, texts)).collect()}
    gone = {i for i in removed if removed[i]}
    assert gone <= {i for i in range(len(texts)) if wanted[i] != i}
    assert len(gone) >= 0.97 * sum(wanted[i] != i for i in range(len(texts)))


def test_style_tree_of_copies(spark):
    # Two articles in many copies each, on two hosts: one of copies alone, one with further pages.
    body = lambda i: f"<article><h1>Head {i}</h1><p>text of article {i}</p></article><section><p>the same on every page</p></section>"
    rows = [(i, f"http://c.org/{i}", body(i % 2)) for i in range(30)] + [(100 + i, f"http://d.org/{i}", body(0 if i < 60 else i)) for i in range(80)]
    found = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {n: "Head {0}\ntext of article {0}".format(i) for n, i in [(i, i % 2) for i in range(30)] + [(100 + i, 0 if i < 60 else i) for i in range(80)]}


def test_names_hide_no_article():
    shown = lambda page: [text for _, text, hidden, _ in html.blocks_of(page) if not hidden]
    article = "<article class='post hentry no-comments'><p>own</p><div class='share'>s</div><div class='comments'><article class='comment'>c</article></div></article>"
    assert shown(f"<html class='js no-hidden'><body class='single right-sidebar'>{article}</body></html>") == ["own"]
    assert shown(f"<body><div class='no-sidebar'><div id='search'>{article}</div></div><div class='sidebar'>x</div></body>") == ["own"]
    assert shown(f"<main class='search-results'><div class='no-sidebar'>{article}<div class='comments'><article>c</article></div></div></main>") == ["own"]
    assert shown("<div class='no-menu'><main>own</main></div><div class='menu'>m</div>") == ["own"]


def test_secrets_of_letters_and_of_odd_hex():
    encode = rank_encoding(RANKS).encode_ordinary
    kinds = lambda x: [k for k, _, _ in secrets.find_spans(x, encode, 1.9)]
    for secret in ("QxZvKjWqPzRtLmXbNcVg", "qxzvkjwqpzrtlmxbncvgkq", "9f3c0a7be1d45286fb0c7", "9F3C0A7BE1D45286FB0C7A913D5E8", "9F3C0A7BE1D45286FB0C7A913D5E8B604C"):
        assert kinds(f"key {secret} end") == ["random"], secret
    for known in ("9F3C0A7BE1D45286FB0C7A913D5E8B60", "internationalization", "getApplicationConfigurationName", "some-dashed-words-in-lines"):
        assert kinds(f"see {known} end") == [], known


def test_tables_of_finished_steps_are_removed(spark):
    folder = shared.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    links = shared.written(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), "links")
    found = shared.components(links)
    shared.removed(links)
    assert {r["component"] for r in found.collect()} == {0} and found.count() == 41
    assert len([x for x in set(os.listdir(folder)) - before if not x.startswith(".")]) == 1
