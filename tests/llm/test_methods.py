"""The methods against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from logsluice.llm import chat, kneser_ney as K, mixing, personal as P, quality_rules as Q, secrets_scan as S, simhash, warc
from logsluice.llm.decontaminate import contained_items
from logsluice.llm.queries import QUERIES
from logsluice.llm.tagger import PAD, Tagger
from logsluice.llm.trigram_query import trigram_query
from logsluice.llm.words import find_words, shingle_hashes, word_hashes

FAST = settings(max_examples=60, deadline=None)


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


# --- SimHash ------------------------------------------------------------------------------------------

def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@FAST
@given(st.text())
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode("utf-8", "ignore")) == slow_fingerprint(text.encode("utf-8", "ignore").decode())


def slow_components(fps):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                label[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_components_over_hot_groups(spark):
    """Balls of near fingerprints, larger than a group may be, chains, and copies."""
    rng = np.random.default_rng(5)
    fps = []
    for center in rng.integers(0, 1 << 63, 6).tolist():
        fps.append(center)
        for _ in range(60):
            fps.append(center ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 3)), replace=False)))
    chain = int(rng.integers(0, 1 << 62))
    for step in range(30):
        chain ^= 1 << (2 * step) | 1 << (2 * step + 1)
        fps.append(chain)
    fps = list(dict.fromkeys(f & (1 << 64) - 1 for f in fps))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    frame = spark.createDataFrame(signed, "fp long")
    expected = slow_components(fps)
    for group_rows in (40, 1024):
        links = simhash.trie_links(frame, group_rows=group_rows)
        assert links.count() < 20 * len(fps)
        roots = {r["fp"]: r["root"] for r in simhash.component_roots(links).collect()}
        got = [roots.get(f, f) for (f,) in signed]
        assert len(set(zip(expected, got))) == len(set(expected)) == len(set(got))


def test_op5_is_whole(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in documents(spark, folder).collect()}
    rows = QUERIES["op5_simhash_near_dedup"](spark, folder).collect()
    ids = sorted(docs)
    fps = [slow_fingerprint(docs[i]) for i in ids]
    component = slow_components(fps)
    smallest = {}
    for i, c in zip(ids, component):
        smallest[c] = min(i, smallest.get(c, i))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == [
        (i, f"{f:016x}", smallest[c]) for i, f, c in zip(ids, fps, component)]


# --- words and decontamination ---------------------------------------------------------------------------

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@FAST
@given(st.lists(st.text(alphabet="abAB01 é.\nß", max_size=30), min_size=1, max_size=5))
def test_words(texts):
    found = find_words([t.encode() for t in texts])
    for i, text in enumerate(texts):
        words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        first, last = found.first[i], found.first[i + 1]
        assert found.text(first, last - first).decode() == " ".join(words)
    hashes = word_hashes(found)
    texts_of = [found.text(i, 1) for i in range(len(hashes))]
    assert len({(t, h) for t, h in zip(texts_of, hashes.tolist())}) == len(set(texts_of)) == len(set(hashes.tolist()))
    if len(hashes) > 2:
        three = [found.text(i, 3) for i in range(len(hashes) - 2)]
        assert len(set(zip(three, shingle_hashes(hashes, 3).tolist()))) == len(set(three))


def test_near_items_and_blocks(spark):
    """A passage with one changed word is near, one with every third changed is not; blocks don't matter."""
    words = [f"w{i}" for i in range(40)]
    near = words[:20] + ["changed"] + words[21:]
    far = [w if i % 3 else "changed" for i, w in enumerate(words)]
    docs = spark.createDataFrame(
        [(1, "intro " + " ".join(near) + " outro"), (2, " ".join(far)), (3, " ".join(words[:9])), (4, "short one here"),
         (5, "Short  ONE, here! short one here")], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words)), (8, "Short one here")], "item_id long, text string")
    results = []
    for block in (100_000, 5):
        rows = contained_items(docs, items, block_patterns=block).collect()
        results.append({r["id"]: (r["n_words"], sorted((s["start"], s["words"], s["item_id"]) for s in r["spans"]),
                                  sorted(r["near"])) for r in rows})
    assert results[0] == results[1]
    got = results[0]
    assert got[1][2] == [7] and len(got[1][1]) == 11 + 10 and got[2] == (40, [], []) and got[3] == (9, [], [])
    assert got[4] == (3, [(0, 3, 8)], []) and got[5] == (6, [(0, 3, 8), (3, 3, 8)], [])


# --- chat -----------------------------------------------------------------------------------------------

TURN = st.tuples(st.text(alphabet="assistantuser\\n\n<", max_size=9) | st.just("assistant"),
                 st.text(alphabet="ab\\ln<>/turn\n</turn>", max_size=20) | st.just("\\### Assistant: </turn> ok"))


@FAST
@given(st.lists(TURN, max_size=6))
def test_template_round_trip(turns):
    text, mask = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[s:e]) for s, e in mask] == [t for r, t in turns if r == "assistant"]


def test_layouts(spark):
    records = [
        ('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}]}', "messages", [("user", "a"), ("assistant", "")]),
        ('{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', "conversations", [("user", "a"), ("assistant", "b")]),
        ('{"prompt":"a","completion":"b"}', "prompt_completion", [("user", "a"), ("assistant", "b")]),
        ('{"instruction":"a","input":"c","output":"b"}', "instruction", [("user", "a\n\nc"), ("assistant", "b")]),
        ('{"output":"b","instruction":"a"}', "instruction", [("user", "a"), ("assistant", "b")]),
        ('{"question":"a","response":"b","system_prompt":"s"}', "question_answer", [("system", "s"), ("user", "a"), ("assistant", "b")]),
        ('{"messages":[]}', "messages", []), ('{"other":{"x":[1]}}', None, None), ("[1]", None, None), ("not json", None, None), (None, None, None)]
    frame = spark.createDataFrame([(i, r[0]) for i, r in enumerate(records)], "id long, record string")
    for r in chat.canonical_turns(frame).collect():
        _, layout, turns = records[r["id"]]
        assert r["layout"] == layout
        assert (None if r["turns"] is None else [(t["role"], t["text"]) for t in r["turns"]]) == turns
    assert chat.paths({"a": [{"b": 1}, {"c": {"d": 2}}], "e": {}}) == {".a[].b", ".a[].c.d", ".e{}"}


# --- personal data ----------------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_base(text):
    def good(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "card":
            doubled = [int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))]
            return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    found = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if good(k, m[0])]
    return sorted(found, key=lambda s: (s[1], list(BASE).index(s[0])))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab@.+-_ 0123456789()1.2.3.4", max_size=40) | st.text(alphabet="4111 -+()", max_size=40))
def test_base_rules(text):
    assert P.base_spans(text) == slow_base(text)


def test_base_rules_are_linear():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1(" * 60_000, "a@b." * 50_000):
        P.base_spans(text)


def test_gradients():
    model, rng = Tagger(P.KINDS), np.random.default_rng(0)
    codes = rng.integers(0, 128, (3, 9)).astype(np.int16)
    codes[1, 6:] = PAD
    tags = np.zeros((3, 9), np.int64)
    tags[0, 2:5], tags[2, 6:8] = [1, 2, 2], [3, 4]
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, gradients = model.loss_and_gradients(codes, tags)
    for name, g in gradients.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, losses = model.p[name][at], []
        for step in (1e-3, -1e-3):
            model.p[name][at] = old + step
            losses.append(model.loss_and_gradients(codes, tags)[0])
        model.p[name][at] = old
        assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(g[at], rel=1e-3)


@pytest.fixture(scope="module")
def tagger(spark):
    docs = documents(spark, "/root/testdata/sf0.1")
    texts = [r["text"] for r in docs.filter("text RLIKE '[0-9@]'").orderBy(F.xxhash64("doc_id")).limit(600).collect()]
    model = Tagger(P.KINDS)
    losses = model.fit(*P.training_windows(texts[:450]), P.STEPS)
    assert losses[-1] < losses[0] / 20
    return model, texts[450:]


def test_held_out_accuracy(tagger):
    model, texts = tagger
    codes, tags = P.training_windows(texts)
    found, sure = model.decode(codes)
    assert (found == tags)[tags > 0].mean() > 0.95
    assert ((found > 0) & (tags == 0)).sum() < 0.05 * (tags > 0).sum()
    assert ((sure >= 0) & (sure <= 1 + 1e-3)).all()


def test_added_spans(tagger):
    """A number next to a phone hides both from the rules; the tagger tells them apart. Base spans stay."""
    model, _ = tagger
    text = "words before +1 (569) 555-6633 4795326016703902 and after " + "nothing here " * 20
    assert P.base_spans(text) == [] or all(s in [x[:3] for x in P.spans_of([text], model)[0]] for s in P.base_spans(text))
    spans = [(k, text[s:e]) for k, s, e, *_ in P.spans_of([text], model)[0]]
    assert ("phone", "+1 (569) 555-6633") in spans and ("card", "4795326016703902") in spans
    assert P.spans_of(["plain words without anything " * 50], model) == [[]]


def test_windows_cover_every_span():
    for at in range(0, 300, 7):
        text = "x" * at + "a@b.co" + "y" * (300 - at)
        starts = P.window_starts(P._codes(text))
        assert any(s <= at and at + 6 <= s + P.WINDOW for s in starts)


def test_reconcile():
    text = "a@b.co " + "+49 30 1234567"
    pieces = [("email", 0, 4, 0.95), ("email", 2, 6, 0.97), ("phone", 7, 21, 0.99), ("card", 8, 20, 0.99), ("email", 3, 9, 0.2)]
    assert [s[:3] for s in P.reconcile(text, [], [p for p in pieces if p[3] > 0.5])] == [("email", 0, 6), ("phone", 7, 21)]
    assert P.reconcile(text, [("email", 0, 6)], pieces[:2]) == [("email", 0, 6, 1.0, True)]
    assert P.redacted(text, P.reconcile(text, [("email", 0, 6)], [pieces[2]])) == "<EMAIL> <PHONE>"


# --- WARC --------------------------------------------------------------------------------------------------

@FAST
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc.loser_tree(runs, key=lambda x: x)) == sorted(x for r in runs for x in r)


@FAST
@given(st.binary(max_size=60), st.text(max_size=10), st.booleans())
def test_record_round_trip(payload, url, revisit):
    data = warc.record(3, url, "2024-01-01T00:00:00Z", payload, "ABC", 9, revisit)
    found = warc.parse(data)
    assert found["payload_bytes"] == len(payload) and found["payload"] == (None if revisit else payload)
    assert (found["page_id"], found["refers_to"]) == (3, 9 if revisit else None)
    with pytest.raises(ValueError):
        warc.parse(data[:-1])


def test_index_is_globally_ordered(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").repartition(5)
    entries = warc.write_archives(pages, warc.fresh_folder(spark, "warc"), file_records=7)
    merged = [warc._order(r.asDict()) for r in warc.merge_index(entries).collect()]
    assert merged == sorted(merged) and len(merged) == pages.count()
    assert entries.select("run").distinct().count() > 5


# --- secrets ---------------------------------------------------------------------------------------------------

def slow_secrets(text, rule):
    found = [m for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.at_least]
    return [(rule.kind, m.start(), m.end()) for m in found]


def test_secrets_against_brute_force(spark):
    pieces = ["password", "PassWord", "token", " = ", ":", '"', "'", "abcdefgh1", "deadbeef" * 4, "AKIA", "AKIA" + "B7" * 9, "api_key=",
              "é", "\U0001F600", "ghp_" + "a" * 36, "\n", "sk_live_" + "x" * 20, "xoxb-1234567890-a", "secret: token : longvalue123"]
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(pieces, int(rng.integers(0, 14)))) for _ in range(300)]
    rows = S.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        every = [(s, rule.base, i) for i, rule in enumerate(S.RULES) for s in slow_secrets(texts[r["id"]], rule)]
        base = [s for s, b, _ in every if b]
        kept = [(s, i) for s, b, i in every if b or not any(x[1] < s[2] and s[1] < x[2] for x in base)]
        expected = [s for s, i in sorted(kept, key=lambda k: (k[0][1], k[1]))]
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == expected, texts[r["id"]]


def test_trigram_queries():
    assert trigram_query("[0-9a-f]{32,}") == frozenset()
    assert trigram_query("AKIA[A-Z0-9]+") == {frozenset({"aki", "kia"})}
    assert trigram_query("(abc|xyz)def") == {frozenset({"abc", "bcd", "cde", "def"}), frozenset({"xyz", "yzd", "zde", "def"})}
    assert trigram_query("a?bcd") == {frozenset({"bcd"})}
    assert trigram_query("(abc)*x") == frozenset()
    for rule in S.RULES:
        for text in ("api_key = 'abcdefgh'", "SECRET:abcdefghi", "AKIA" + "A" * 16, "ghp_" + "a" * 40, "sk_live_" + "1" * 20,
                     "xoxb-aaaaaaaaaaaa", "-----BEGIN RSA PRIVATE KEY-----"):
            clauses = trigram_query(rule.pattern)
            if re.search(rule.pattern, text) and clauses:
                assert any(all(t in text.lower() for t in clause) for clause in clauses)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64, 1000])
def test_running_sums(spark, n):
    values = list(range(n))
    got = spark.createDataFrame([(values,)], "v array<int>").select(S.running_sums(F.col("v")).alias("s")).first()["s"]
    assert got == np.cumsum(values).tolist()


# --- Kneser-Ney --------------------------------------------------------------------------------------------------

def slow_model(texts):
    """Interpolated modified Kneser-Ney over tuples of character ids."""
    counts = {k: Counter() for k in range(1, K.ORDER + 1)}
    for t in texts:
        ids = [0] * (K.ORDER - 1) + [ord(c) + 1 for c in t]
        for i in range(K.ORDER - 1, len(ids)):
            counts[K.ORDER][tuple(ids[i - K.ORDER + 1:i + 1])] += 1
    for k in range(K.ORDER - 1, 0, -1):
        for gram in counts[k + 1]:
            counts[k][gram[1:]] += 1
    d = {k: K.discounts(*(sum(1 for c in counts[k].values() if c == i) for i in range(1, 5))) for k in counts}
    contexts = {k: defaultdict(list) for k in counts}
    for k in counts:
        for gram, c in counts[k].items():
            contexts[k][gram[:-1]].append(c)

    def off(k, c):
        return d[k].one if c == 1 else d[k].two if c == 2 else d[k].more

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (1 << K.CHAR_BITS)
        below = contexts[k].get(gram[:-1])
        if not below:
            return p(gram[1:])
        weight = sum(off(k, c) for c in below) / sum(below)
        c = counts[k].get(gram, 0)
        return (max(c - off(k, c), 0) / sum(below) if c else 0) + weight * p(gram[1:])

    return p


@pytest.mark.parametrize("shard_entries", [10_000_000, 40])
def test_perplexity_against_brute_force(spark, shard_entries):
    train = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "on the mat the cat sat", ""]
    score = ["the cat", "zebra the", "", "q", "a dog sat on the mat"]
    model = K.train(spark.createDataFrame([(t,) for t in train], "text string"))
    frame = spark.createDataFrame(list(enumerate(score)), "id long, text string")
    parts = list(K.shards(model, shard_entries))
    assert (len(parts) == 1) == (shard_entries > 1000)
    p = slow_model(train)
    for r in K.perplexity(frame, parts, ["id"]).collect():
        text = score[r["id"]]
        ids = [0] * (K.ORDER - 1) + [ord(c) + 1 for c in text]
        logs = [math.log(p(tuple(ids[i - K.ORDER + 1:i + 1]))) for i in range(K.ORDER - 1, len(ids))]
        expected = math.exp(-sum(logs) / len(logs)) if logs else None
        assert r["perplexity"] == (pytest.approx(expected, rel=1e-4) if logs else None)


def test_probabilities_sum_to_one():
    p = slow_model(["abracadabra", "banana"])
    assert sum(p((98, 115, c)) for c in range(1 << K.CHAR_BITS)) == pytest.approx(1)


@FAST
@given(st.sets(st.integers(0, 1 << 60), min_size=1, max_size=200))
def test_hash_table(keys):
    keys = np.array(sorted(keys), np.int64)
    table = K.HashTable(keys[::2], np.arange(len(keys[::2]), dtype=np.float32))
    found, values = table.find(keys)
    assert found.tolist() == [i % 2 == 0 for i in range(len(keys))]
    assert values[found].tolist() == list(range(len(keys[::2])))


def test_classifier_tells_good_from_bad(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    judged = K.classify(docs, labels).join(labels.withColumnRenamed("doc_id", "id"), "id")
    share = {r["quality"]: r["kept"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.98 and share[0] < 0.6


# --- quality rules ------------------------------------------------------------------------------------------------

def slow_numbers(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n#|é\t\x0b ", max_size=80))
def test_numbers(text):
    assert Q.numbers(text.encode()) == slow_numbers(text)


def test_upper_bound_is_exact():
    for rejected, total, delta in ((0, 300, 0.05), (3, 1000, 0.01), (50, 100, 0.05), (7, 20, 0.001), (99, 100, 0.05)):
        bound = Q.upper_bound(rejected, total, delta)
        tail = sum(math.comb(total, k) * bound ** k * (1 - bound) ** (total - k) for k in range(rejected + 1))
        assert tail == pytest.approx(delta, rel=1e-6)
    assert Q.upper_bound(5, 5, 0.05) == 1.0 and Q.upper_bound(0, 0, 0.05) == 1.0


def test_cutoffs_hold_their_guarantee(spark):
    """The chosen cutoff is the last before the first of the grid whose bound is above alpha."""
    good = [("a", 0.3 if i < 30 else 0.0) for i in range(10_000)] + [("b", 0.0)] * 20
    frame = spark.createDataFrame([(s, x, 0.0, 0.0, 5.0) for s, x in good],
                                  "stratum string, symbol_ratio double, repeat_ratio double, dup_line_ratio double, long_words double")
    got = {(r["stratum"], r["rule"]): r["cutoff"] for r in Q.choose_cutoffs(frame).collect()}
    assert got[("a", "symbol_ratio")] == 0.05 and got[("a", "long_words")] == 8.0
    assert got[("b", "symbol_ratio")] is None
    strict = {(r["stratum"], r["rule"]): r["cutoff"] for r in Q.choose_cutoffs(frame, alpha=0.003).collect()}
    assert strict[("a", "symbol_ratio")] == 0.5


# --- mixing -----------------------------------------------------------------------------------------------------

def test_poisson_steps(spark):
    for rate in (0.0, 0.3, 2.5, 40.0):
        steps = spark.range(1).select(mixing.poisson_steps(F.lit(rate)).alias("s")).first()["s"]
        for k in (0, 1, 5, 40):
            exact = sum(math.exp(-rate) * rate ** i / math.factorial(i) for i in range(k + 1))
            assert steps[k] == pytest.approx(exact, rel=1e-12)
        assert steps[-1] == pytest.approx(1, abs=1e-12)


def test_shares_meet_their_targets(spark):
    docs = spark.range(60_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("source"),
        F.lit("ten chars.").alias("text"))
    rows = mixing.mix(docs, {"hot": 0.2, "b": 0.5}, 0.3).groupBy("source").count().collect()
    total = sum(r["count"] for r in rows)
    share = {r["source"]: r["count"] / total for r in rows}
    assert share["hot"] == pytest.approx(0.2, abs=0.01) and share["b"] == pytest.approx(0.5, abs=0.01)
    order = [r["mix_order"] for r in mixing.mix(docs.limit(500), {"hot": 1.0}, 1.0).collect()]
    assert order == sorted(order)


# --- the pipeline ----------------------------------------------------------------------------------------------------

def test_pipeline_stages_agree_with_the_queries(spark, folder):
    """Each stage's decisions, worked out plainly from the operators' results on its own input."""
    import corpus_pipeline as C
    from logsluice.llm import decontaminate

    folder = "/root/testdata/sf0.01"
    docs = documents(spark, folder)
    labels, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = {r["id"] for r in K.classify(docs, labels).collect() if r["kept"]}
    one = C.quality(spark, docs, folder)
    assert {r["doc_id"] for r in one.collect()} == kept
    rows = {r["doc_id"]: r["text"] for r in one.collect()}
    ids = sorted(rows)
    fps = [slow_fingerprint(rows[i]) for i in ids]
    first = {}
    for i, c in zip(ids, slow_components(fps)):
        first.setdefault(c, i)
    two = C.near_dedup(spark, one, folder)
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(first.values())
    three = C.decontamination(spark, two, folder)
    found = decontaminate.contamination(two, items).collect()
    clean = {r["id"] for r in found if not r["contaminated"] and not r["near_items"]}
    assert {r["doc_id"] for r in three.collect()} == clean and len(clean) < len(found)
    four = C.personal_data(spark, three, folder)
    before, after = ({r["doc_id"]: r for r in x.collect()} for x in (three, four))
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert not slow_base(r["text"]) and r["n_chars"] == (len(r["text"]) if r["text"] != before[i]["text"] else before[i]["n_chars"])
        if not slow_base(before[i]["text"]):
            assert len(r["text"]) >= len(before[i]["text"]) - 60
    five = C.mixture(spark, four, folder).collect()
    assert {r["doc_id"] for r in five} <= after.keys()
    copies = Counter(r["doc_id"] for r in five)
    for r in five:
        u = int(hashlib.md5(f"{mixing.SEED}/{r['doc_id']}/count".encode()).hexdigest()[:13], 16) / (1 << 52)
        rate, n, total = r["mix_rate"], 0, math.exp(-r["mix_rate"])
        while total <= u:
            n += 1
            total += math.exp(-rate) * rate ** n / math.factorial(n)
        assert copies[r["doc_id"]] == n
