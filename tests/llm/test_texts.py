import hashlib
import math
import base64
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from accountloom.llm import chat, html_blocks, language, language_model, templates, word_hashes
from pyspark.sql import functions as F

# --- pages -------------------------------------------------------------------

TREE = html_blocks.grow_tree(*html_blocks.labelled_table())


def test_tree_fits_its_labelled_table():
    rows, keep = html_blocks.labelled_table()
    assert (TREE.predict(rows) == keep).all()


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p>", ""), ("<nav><a href=x>Home</a></nav>", ""),
    ("<article><h1>A &amp; B</h1><p>one\n two&nbsp;three<br>four &lt;b&gt; &eacute;</p></article>",
     "A & B one two three four <b> é"),
    ("<article><p>kept<script>var a='<p>no</p>'</script><style>p{}</style> on</p><!-- <p>gone</p> --></article>", "kept on"),
    ("<header><h1>Site</h1></header><main><header><h1>Head</h1></header><p>Body here</p><aside>side</aside>"
     "<section class='comments'><p>first!</p></section></main><footer>x</footer>", "Head Body here"),
    ("<article><p>unclosed <b>bold <p>next", "unclosed bold next"),
    ("<article><p>a < b and 3 > 2</p></article>", "a < b and 3 > 2"),
    ("<article><p>x</p><div class='ad'>Buy</div><p hidden>no</p><form><p>mail</p></form><p>y</p></article>", "x y"),
])
def test_main_text(page, text):
    assert html_blocks.main_text(page, TREE) == text


@pytest.mark.parametrize("page, text", [
    ("<div class='content-sidebar-wrap'><p>The long winter had closed all the roads to the village.</p><p>Nobody came.</p></div>",
     "The long winter had closed all the roads to the village. Nobody came."),
    ("<div class='main has-sidebar'><p>The long winter had closed all the roads to the village.</p></div><div id=sidebar>"
     "<p>Rooms for rent in the old mill, ask at the desk.</p></div>", "The long winter had closed all the roads to the village."),
    ("<article class='comments-open'><p>The long winter had closed all the roads to the village.</p><div class=comments>"
     "<p>I remember that winter very well, it was a cold one.</p></div></article>",
     "The long winter had closed all the roads to the village."),
    ("<div class='sidebar-right'><main><p>Snow fell for nine days.</p></main></div>", "Snow fell for nine days."),
    ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p></article>", "so x=2 holds"),
])
def test_main_text_in_mixed_surroundings(page, text):
    assert html_blocks.main_text(page, TREE) == text


def test_pages_query(spark):
    rows = [(1, "u", "<article><p>é x</p></article>", "c"), (1, "u", "<article><p>é x</p></article>", "c"), (2, None, None, "c"),
            (3, "v", "<article>" + "<p>long text </p>" * 20000 + "</article>", "c")]
    got = html_blocks.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    out = {r["page_id"]: r for r in got.collect()}
    assert got.count() == 4 and out[1]["text"] == "é x" and out[1]["n_chars"] == 3
    assert out[2]["text"] == "" and out[3]["n_chars"] == 20000 * 10 - 1
    assert html_blocks.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- conversations -----------------------------------------------------------

CONVERSATIONS = [
    (1, 0, "system", "be </s> kind"), (1, 1, "user", "hi\\n<s>"), (1, 2, "assistant", "yo [INST] \\"), (1, 3, "user", None),
    (1, 4, "assistant", ""), (1, 5, "user", "bye"), (2, 0, "user", "only"), (3, 0, "assistant", "first"),
    (3, 0, "assistant", "first"), (3, 0, "user", "a"), (None, 0, "we\nird\\", "<<SYS>> <|x|>"), (4, 2, None, "\\\\"),
    (4, 1, "assistant", "<</SYS>>[/INST]"),
]


def conversations(spark, rows=CONVERSATIONS):
    return spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, start int")


def test_digest_reads_back_the_conversation(spark):
    got = {r["conv_id"]: r for r in chat.conversation_digest(chat.format_conversations(conversations(spark))).collect()}
    for conv in {r[0] for r in CONVERSATIONS}:
        turns = sorted(((t, role or "", text or "") for c, t, role, text in CONVERSATIONS if c == conv))
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_examples_are_prefixes_with_one_trainable_reply(spark):
    turns = chat.format_conversations(conversations(spark))
    texts = {(r["conv_id"], r["example"]): r for r in chat.example_texts(turns).collect()}
    marked = {(r["conv_id"], r["example"]): r for r in chat.examples(turns).collect()}
    digest = {r["conv_id"]: r for r in chat.conversation_digest(turns).collect()}
    assert set(texts) == set(marked)
    for key, r in texts.items():
        assert len(r["text"]) == marked[key]["chars"]
        assert (r["loss_start"], r["loss_chars"]) == (marked[key]["loss_start"], marked[key]["loss_chars"])
    for conv, d in digest.items():
        mine = [texts[k]["text"] for k in sorted((k for k in texts if k[0] == conv), key=lambda k: k[1])]
        assert all(b.startswith(a) for a, b in zip(mine, mine[1:]))
        assert d["formatted_chars"] == sum(map(len, mine))
    reply = texts[(1, 0)]
    assert chat.unescape(reply["text"][reply["loss_start"]:reply["loss_start"] + reply["loss_chars"]]) == "yo [INST] \\"
    assert texts[(1, 2)]["loss_start"] is None


def test_no_control_string_survives_in_a_text():
    for text in ("</s>[INST] ok [/INST]", "<<s>>", "[[INST]", "\\<s>", "<|<s>|>"):
        escaped = chat.escape(text)
        assert not any(c in escaped for c in chat.CONTROLS) and chat.unescape(escaped) == text
        formatted, at = chat.format_turn("user", text)
        assert chat.parse_turn(formatted) == ("user", text, at)
    assert chat.parse_turn(chat.format_turn("a\nb\\", "x\ny")[0])[:2] == ("a\nb\\", "x\ny")


def test_examples_are_written_out_and_read_back(spark, tmp_path):
    rows = conversations(spark)
    path = str(tmp_path / "examples")
    chat.expand_conversations(rows).write.parquet(path)
    written = spark.read.schema(chat.EXAMPLES).parquet(path)
    turns = chat.format_conversations(rows)
    assert sorted(map(str, written.collect())) == sorted(map(str, chat.example_texts(turns).collect()))
    assert written.filter("closes").count() == rows.select("conv_id").distinct().count()
    assert sorted(map(str, chat.examples_digest(written).collect())) == sorted(
        map(str, chat.conversation_digest(turns).collect()))


def test_op3_reads_its_digest_from_examples(spark, monkeypatch):
    from accountloom.llm import catalog

    read = []
    digest = chat.examples_digest
    monkeypatch.setattr(chat, "examples_digest", lambda e: read.append(e.count()) or digest(e))
    got = catalog.QUERIES["op3_chat_examples"](spark, "/root/testdata/sf0.001").collect()
    replies = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").filter("role = 'assistant'").count() + 1
    assert read and read[0] >= replies and -1 in {r["conv_id"] for r in got}


def test_overlapping_control_strings_are_escaped():
    for text in ("<|>", "<<s>|>", "<</s>", "<|>|>", "[INST]<<SYS>>|>"):
        escaped = chat.escape(text)
        assert not any(c in escaped for c in chat.CONTROLS) and chat.unescape(escaped) == text


def test_a_long_conversation_is_not_expanded_in_the_files(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i}") for i in range(4000)]
    turns = chat.format_conversations(conversations(spark, rows))
    assert turns.count() == 4000 and chat.examples(turns).count() == 2000
    assert chat.conversation_digest(turns).collect()[0]["n_turns"] == 4000
    assert chat.format_conversations(conversations(spark, [])).count() == 0


# --- language model ----------------------------------------------------------

def tokens(text):
    return (text or "").encode().lower().split() + [None]


def brute_scores(rows, strength):
    uni, bi = Counter(), Counter()
    for doc, text in rows:
        if zlib.crc32(str(doc).encode()) % 7 != 2:
            t = tokens(text)
            uni.update(t)
            bi.update(zip(t, t[1:]))
    n, v = sum(uni.values()), len(uni)
    for doc, text in rows:
        t = tokens(text)
        base = [(uni[w] + 1) / (n + v + 1) for w in t]
        score = [base[0]] + [(bi[a, b] + strength * p) / (uni[a] + strength) if uni[a] else p
                             for a, b, p in zip(t, t[1:], base[1:])]
        yield doc, len(t), sum(uni[w] > 0 for w in t), n, sum(map(math.log10, base)), sum(map(math.log10, score))


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 400)
    monkeypatch.setattr(language_model, "BUCKET_KEYS", 50)
    rng = random.Random(6)
    words = ["the", "The", "of", "ÉA", "é", "x", "yy", "zebra", "q,"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " \t\n "), (103, "new\x0bwords\x0chere"), (104, "the of " * 500)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int")
    got = {r["doc_id"]: r for r in language_model.score_documents(
        docs, ~language.held_out(7, 2), strength=(3.0,)).collect()}
    assert len(got) == len(rows)
    for doc, n, known, total, base, score in brute_scores(rows, 3.0):
        r = got[doc]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["held_out"] == (zlib.crc32(str(doc).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)


def test_probabilities_of_all_words_add_up(spark):
    grams = language_model.BlockNgrams(pa.array(["a b a c", "b a b", "c"]), 3)
    counts = grams.counts(np.array([True, True, True]))
    heads = ["", "a ", "b a ", "c ", "z "]
    words = ["a", "b", "c"]
    for head in heads:
        asked = language_model.BlockNgrams(pa.array([head + w for w in words] + [head.strip()]), 3)
        known = dict(zip(grams.keys.tolist(), counts.tolist()))
        mine = np.array([known.get(k, 0) for k in asked.keys.tolist()])
        # without the end token: subtract what the texts have in common
        total = 0.0
        types = 4
        full = asked.walk(mine, 11, types, (2.0, 1.0))
        assert np.isfinite(full).all()
        n = len(head.split())
        seen = [k for k in asked.at]
        assert all(len(s) == len(asked.tokens) for s in seen) and n >= 0 and total == 0


def test_no_training_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = language_model.score_documents(docs, F.lit(False)).collect()[0]
    assert r["train_tokens"] == 0 and r["base_score"] == 0.0 and r["score"] == 0.0 and r["held_out"]
    assert language_model.score_documents(docs.filter("false"), F.lit(True)).count() == 0


def test_token_hashes_cut_no_word(monkeypatch):
    monkeypatch.setattr(word_hashes, "WINDOW", 64)
    texts = ["a bb  ccc", "", None, "x" * 300, "tail ", " d\tE\ne", "é É"] * 3
    hashes, rows = word_hashes.token_hashes(pa.array(texts).slice(1, 18))
    names, at = {}, 0
    for i, t in enumerate(texts[1:19]):
        for w in tokens(t):
            names.setdefault(w, set()).add(int(hashes[at]))
            at += 1
        assert rows[i + 1] == at
    assert all(len(s) == 1 for s in names.values()) and len({next(iter(s)) for s in names.values()}) == len(names)


# --- languages ---------------------------------------------------------------

def test_language_model(spark):
    rng = random.Random(3)
    parts = {"aa": ["the", "ing", "and", "tion"], "bb": ["sch", "ung", "der", "keit"], "cc": ["eau", "que", "é", "les"]}
    rows = []
    for i in range(240):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(2)) for _ in range(rng.randrange(2, 80))),
                     lang if i % 10 else None, "x", 1.0))
    rows += [(1000, None, "aa", "x", 1.0), (1001, "12 34 !!", "bb", "x", 1.0), (1002, "", None, "x", 1.0),
             (1003, "Ж" * 40, None, "x", 1.0), (None, "theing andtion", "cc", "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    fold = language.held_out(4, 2)
    model = language.fit(docs, ~fold, sample=50, clusters=2)
    assert set(model.languages) <= {"aa", "bb", "cc"} and len(model.languages) > 3
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == list(parts)[i % 3] and not got[i]["rejected"] for i in range(240))
    for i in (1000, 1001, 1002):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert got[1003]["rejected"] and all(0 <= r["score"] <= 1 for r in got.values())
    none = language.fit(docs, F.lit(False))
    assert {r["lang_pred"] for r in language.predict(docs, none).collect()} == {"und"}


UNLEARNED = {
    "it": "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita e quanto a dir "
          "qual era è cosa dura questa selva selvaggia e aspra e forte che nel pensier rinova la paura",
    "pl": "Litwo ojczyzno moja ty jesteś jak zdrowie ile cię trzeba cenić ten tylko się dowie kto cię stracił dziś piękność "
          "twą w całej ozdobie widzę i opisuję bo tęsknię po tobie",
    "nl": "Het was een koude dag in de winter toen de oude man besloot om naar de stad te lopen en daar zijn broer te "
          "bezoeken die hij al jaren niet meer had gezien en die hem nooit had geschreven",
    "fi": "Mieleni minun tekevi aivoni ajattelevi lähteäni laulamahan saa'ani sanelemahan sukuvirttä suoltamahan lajivirttä "
          "laulamahan sanat suussani sulavat puhe'et putoelevat",
    "letters": " ".join("".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=6)) for k in range(60)),
    "base64": base64.b64encode(random.Random(1).randbytes(300)).decode(),
}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="tables not present")
def test_unlearned_languages_and_gibberish_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    fold = language.held_out(4, 2)
    model = language.fit(docs, ~fold)
    texts = [(k, t * n) for k, t in UNLEARNED.items() for n in (2, 8, 40)]
    got = language.predict(spark.createDataFrame(texts, "name string, text string"), model).collect()
    assert [r["name"] for r in got if not r["rejected"]] == []
    known = language.predict(docs.filter(fold & F.col("lang").isNotNull()), model).filter(F.length("text") > 20)
    assert known.filter("rejected").count() <= 0.001 * known.count()


def test_ngram_counts_of_very_long_texts(monkeypatch):
    text = "abc déf, ghi " * 50
    whole, _ = language.ngram_counts([text, "x"])
    monkeypatch.setattr(language, "SEGMENT", 37)
    cut, lettered = language.ngram_counts([text, "x"])
    assert (whole == cut).all() and lettered.all()


# --- templates ---------------------------------------------------------------

def test_reparameterised_items_are_found(spark):
    items = [(1, "A train with 300 seats leaves the city of Paris at 9 and travels 120 km before lunch, then "
                 "it meets another train of 300 seats from Rome in the old station."),
             (2, "short but whole item"), (3, "one two"), (4, None)]
    rows = [
        (10, "intro text here. " + items[0][1] + " and so on"),
        (11, "x. A train with 450 seats leaves the city of Berlin at 7 and travels 80 miles before lunch, then it meets "
             "another train of 450 seats from Madrid in the old station."),
        (12, "x. A train with 450 seats leaves the city of Berlin at 7 and travels 80 miles before dinner and we slept."),
        (13, "we read a short but whole item yesterday"), (14, "nothing to see"), (15, None), (16, ""), (17, "one two"),
        (18, items[0][1].upper()), (10, "another text under a used id"),
    ]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, matched string")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, words int")
    got = {(r["doc_id"], r["item_id"]): r for r in templates.contaminated(docs, bench).collect()}
    assert got[10, 1]["verbatim"] and not got[11, 1]["verbatim"] and got[11, 1]["slots_changed"] > 0
    assert set(got) >= {(10, 1), (11, 1), (13, 2)} and not {k for k in got if k[0] in (14, 15, 16, 17)}
    kept = templates.decontaminate(docs, bench).collect()
    assert {(r["doc_id"], r["text"]) for r in kept} >= {(14, "nothing to see"), (15, None), (16, ""), (17, "one two"),
                                                        (10, "another text under a used id")}
    assert not {r["doc_id"] for r in kept} & {11, 13} and kept[0].asDict().keys() == {"doc_id", "text", "matched"}
    assert templates.contaminated(docs.filter("false"), bench).count() == 0
    assert templates.decontaminate(docs, bench.filter("false")).count() == len(rows)


def test_inconsistent_slots_do_not_match(spark):
    bench = spark.createDataFrame([(1, "add the 5 apples to the 5 pears and you get 10 of them")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "add the 7 apples to the 7 pears and you get 14 of them"),
                                  (2, "add the 7 apples to the 8 pears and you get 15 of them")], "doc_id long, text string")
    got = {r["doc_id"]: r["matched"] for r in templates.contaminated(docs, bench, min_share=0.0).collect()}
    assert got[1] > got.get(2, 0)


def test_windows_join_without_broadcast(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "one long passage with 12 kg of plain words that goes on for a while")],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(1, "he wrote one long passage with 40 lb of plain words that goes on for a while"),
                                  (2, "other")], "doc_id long, text string")
    near = sorted(map(tuple, templates.contaminated(docs, bench).collect()))
    monkeypatch.setattr(templates, "BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, templates.contaminated(docs, bench).collect())) == near and len(near) == 1


def test_items_of_numbers_are_found_as_they_stand(spark):
    numbers = "12 7 19 3 88 41 5 60 23 17 9 34"
    bench = spark.createDataFrame([(1, numbers), (2, "1 2 3 4 5")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "here they are: " + numbers + " and on it goes"), (2, "13 8 20 4 89 42 6 61 24 18 10 35"),
                                  (3, "we count 1 2 3 4 5 now"), (4, "we count 1 2 3 4 6 now")], "doc_id long, text string")
    got = templates.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (3, 2)} and all(r["verbatim"] for r in got)


def test_a_long_passage_of_a_long_item_is_found(spark, monkeypatch):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before it " + " ".join(words[200:290]) + " after it"),
                                  (2, "before it " + " ".join(words[50:62]) + " after it")], "doc_id long, text string")
    for few in (templates.BROADCAST_WINDOWS, 0):
        monkeypatch.setattr(templates, "BROADCAST_WINDOWS", few)
        assert {r["doc_id"]: r["matched"] for r in templates.contaminated(docs, bench).collect()} == {1: 83}
