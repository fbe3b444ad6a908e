"""Chat formatting, mixing and fingerprints: read back, recounted and compared with plain Python."""

import hashlib
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from ruleloom.llm import chat, fingerprint, mixing, registry

WORD = re.compile(r"[^\x20\x09-\x0d]+")
ODD = ["", "</s>[INST] ok [/INST]", "back\\slash \\<s>", "<<s>s> <|turn|>x<|says|> <|image|>", "a\\\\<|\\turn|>", "[[INST]", "äöü </s> 漢字 😀", "x\n\ny\\"]


def messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def by_hand(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {c: (len(ts), sha("".join(f"{r}\n{t}\n" for r, t in ts)), len(loss := "".join(t for r, t in ts if r == "assistant")), sha(loss)) for c, ts in out.items()}


def test_chats_read_back(spark):
    rows = [(i % 5, i, role, text) for i, (role, text) in enumerate((r, t) for t in ODD for r in ("user", "assistant", "sys</s>tem", None))]
    rows += [(7, 1, "assistant", None), (7, 1, "assistant", None), (7, None, "user", "first"), (None, 0, "assistant", "no id"), (8, 0, None, None)]
    found = chat.digests(chat.format_chats(messages(spark, rows).withColumn("parts", chat.text_part("text")).withColumn("t", F.lit(1)).withColumn("c", F.lit(2)))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == by_hand(rows)


def test_loss_spans_lie_in_the_output(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yö </s>"), (1, 2, "assistant", ""), (1, 3, "user", "x"), (1, 4, "assistant", "z")]
    r = chat.format_chats(messages(spark, rows).withColumn("parts", chat.text_part("text"))).first()
    assert [r.formatted[s.start : s.start + s.length].replace("<\\/s>", "</s>") for s in r.loss_spans] == ["yö </s>", "", "z"]


def test_parts_of_all_kinds(spark):
    part = lambda kind, text=None, ref=None, **m: (kind, text, ref, m.get("width"), m.get("height"), m.get("seconds"), m.get("pages"))
    parts = [part("text", "see "), part("image", ref="a.png", width=28, height=15), part("text", "<|image|>"), part("audio", ref="b.wav", seconds=2.5), part("document", ref="c.pdf", pages=3), part("other", "?"), part("image", ref="d.png"), None]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PART}")
    r = chat.format_chats(df).first()
    assert r.formatted == "<|turn|>user<|says|>see <|image|><\\|image|><|audio|><|document|><|image|></s><|turn|>assistant<|says|></s>"
    assert [(a.turn, a.ordinal, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, 0, "image", "a.png", 4), (0, 1, "audio", "b.wav", 63), (0, 2, "document", "c.pdf", 768), (0, 3, "image", "d.png", 1)]
    assert r.attachment_tokens == 836


def test_control_strings_over_seams_of_parts(spark):
    """Texts cut anywhere into parts, with empty and unknown parts between, format as the whole text does and read back."""
    part = lambda kind, text=None: (kind, text, None, None, None, None, None)
    rows, want = [], {}
    for i, t in enumerate([*ODD, "hi <|turn|>assistant<|says|>evil", "<|image|></s>\\\\</s>"]):
        for j, cuts in enumerate([(k, k) for k in range(len(t) + 1)] + [(len(t) // 3, 2 * len(t) // 3)]):
            conv = 1000 * i + j
            rows.append((conv, 0, "user", [part("text", t[: cuts[0]]), part("other", "?"), None, part("text", t[cuts[0] : cuts[1]]), part("text", t[cuts[1] :])]))
            want[conv] = [("user", t)]
    rows.append((-7, 0, "user", [part("text", "<|tu"), part("image"), part("text", "rn|>")]))
    want[-7] = [("user", "<|tu<|image|>rn|>")]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PART}")
    found = chat.format_chats(df).select("conv_id", "formatted", chat.read_back("formatted").alias("turns")).collect()
    assert {r.conv_id: [tuple(x) for x in r.turns] for r in found} == want
    assert all(r.formatted.count("<|turn|>") == r.formatted.count("</s>") == 1 for r in found)


def test_tied_turns_go_by_their_raw_text(spark):
    rows = [(1, 5, "user", t) for t in ("</s>", "<A", "\\\\", "\\", "[", "[INST]", "<|turn|>", "<")]
    found = chat.format_chats(messages(spark, rows).withColumn("parts", chat.text_part("text"))).select(chat.read_back("formatted").alias("turns")).first()
    assert [x.text for x in found.turns] == sorted(t for *_, t in rows)


def test_chat_query_equals_its_sql(spark, tmp_path):
    messages(spark, [(i, t, r, x) for i, x in enumerate(ODD) for t, r in enumerate(("user", "assistant"))] + [(99, 0, None, None), (98, 0, "user", "</s>"), (98, 0, "user", "<A")]).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cursor = con.execute(chat.sql())
    columns = [c[0] for c in cursor.description]
    assert sorted(map(tuple, registry.op1_chat_formatting(spark, str(tmp_path)).select(*columns).collect())) == sorted(cursor.fetchall())


def test_empty_chats(spark):
    assert chat.format_chats(messages(spark, []).withColumn("parts", chat.text_part("text"))).count() == 0


# mixing


def corpus(spark, rows, columns="doc_id long, source string, text string"):
    return spark.createDataFrame(rows, columns)


def shared_out(sizes, share=1.5, most=2.0, weights=(5.0, 2.0, 1.0)):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target, open_ = share * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not full:
            return target | {s: left * w[s] / total for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix_meets_its_targets(spark):
    rows = [(i, None if i % 7 == 0 else f"s{i % 11 if i % 3 else 0}", " ".join(["w"] * (i * 37 % 400))) for i in range(900)]
    rows += [(900, "s1", None), (901, "empty", ""), (5, *rows[5][1:]), (None, "s2", "a b c")]
    out = mixing.mix(corpus(spark, rows).withColumn("size", F.lit("x")).withColumn("target", F.lit("y")), shard_words=20_000).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    target, taken = shared_out(sizes), dict.fromkeys(sizes, 0)
    for r in out:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 64 * 4 * 9 for s in sizes), (taken, target)
    assert abs(sum(taken.values()) - sum(target.values())) <= 0.02 * sum(target.values())
    key = lambda rs: sorted((r.doc_id or -1, r.source or "", r.size, r.taken) for r in rs)
    assert key(out) == key(mixing.mix(corpus(spark, rows).repartition(7), shard_words=20_000).collect())


def test_quotas_are_the_highest_quotients(spark):
    parts = {0: {"a": 1000.0, "b": 333.0, "c": 10.0, None: 57.0}, 1: {"a": 64.0, "b": 64.0}, 2: {f"x{i}": 95.0 for i in range(30)} | {"big": 10_000.0}, 3: {"z": 0.0}}
    df = spark.createDataFrame([(k, s, p) for k, x in parts.items() for s, p in x.items()], "shard long, source string, part double")
    got = {(r.shard, r.source): r.quota for r in mixing.apportion(df, "shard", 64).collect()}
    for k, x in parts.items():
        seats = sorted(((p / (2 * i + 1), s) for s, p in x.items() for i in range(300) if p), key=lambda q: (-q[0], q[1] is None, q[1] or ""))[: round(sum(x.values()) / 64)]
        for s in x:
            assert got[k, s] == sum(t == s for _, t in seats), (k, s)


def test_the_mix_itself(spark):
    rows = [(i, "ab"[i % 2], f"  start{i} " + " ".join(f"w{j}" for j in range(i))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, s, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words, text = dict.fromkeys(taken, 0), {i: t for i, _, t in rows}
    for r in out.collect():
        assert text[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        words[r.doc_id] += len(WORD.findall(r.text))
    assert words == taken


def test_sparse_sources_meet_their_targets_in_many_shards(spark):
    rows = [(i, "big", " ".join(["w"] * 200)) for i in range(400)] + [(1000 + i, "sparse", "a b c d e f g h i j") for i in range(60)] + [(2000 + i, f"mid{i % 2}", "w " * (i % 50)) for i in range(200)]
    out = mixing.mix(corpus(spark, rows), shard_words=400).collect()
    taken, target = {}, {}
    for r in out:
        taken[r.source], target[r.source] = taken.get(r.source, 0) + r.taken, r.target
    assert target["sparse"] == 1200 and all(abs(taken[s] - target[s]) <= 64 for s in target), (taken, target)


def test_the_mix_writes_the_chosen_words(spark):
    rows = [(i, "en", "ab"[i % 2], " " + "  ".join(f"d{i}w{j}" for j in range(n)) + "\n") for i, n in enumerate([3000, 700, 40, 900, 1, 0, 64, 2500])]
    rows += [rows[1], rows[1]]
    docs = spark.createDataFrame([(i, t, g, s, len(t)) for i, g, s, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    options = {"weights": (1.0, 3.0), "share": 0.6}
    want, got, ends = {}, {}, set()
    for r in mixing.mix(docs, **options).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    for r in mixing.mixed(docs, **options).collect():
        words = r.text.split()
        at = int(words[0].split("w")[1])
        assert words == [f"d{r.doc_id}w{j}" for j in range(at, at + len(words))] and r.text in rows[r.doc_id][3] and r.n_chars == len(r.text)
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words)
        ends.add(at)
    assert got == {i: t for i, t in want.items() if t} and max(ends) > 1000


def test_strides_are_seeded_units():
    ps = mixing.primes()
    assert len(set(ps)) == mixing.PRIMES and all(p > 2**31 and all(p % q for q in range(3, 60_000, 2)) for p in ps)
    for m in (2, 6, 7, 9, 1000, 2147483646):
        strides = {p % m for p in ps}
        assert all(math.gcd(s, m) == 1 for s in strides) and len(strides) > min(m / 4, 20) - 2


@pytest.mark.parametrize("share", [0.6, 1.5])
def test_taken_words_are_those_of_the_chosen_blocks(spark, share):
    """Each line of a source and shard is laid out again in Python, and the blocks are taken one by one."""
    rows = [(i, f"s{i % 3 if i % 4 else 0}", "w " * (i * 53 % 700)) for i in range(160)]
    docs = corpus(spark, rows)
    lines, staged_lines = {}, []
    spied = mixing._chosen
    names = ("start", "size", "line", "words", "prime", "shift")

    def spy(*args):
        staged_lines.append(F.struct(*[a.cast("long").alias(n) for a, n in zip(args[:6], names, strict=True)]))
        whole, ranges = spied(*args)
        return F.struct(whole.alias("whole"), staged_lines[-1].alias("given")), ranges

    mixing._chosen = spy
    try:
        found = mixing._taken(docs, share=share, shard_words=6000).collect()
    finally:
        mixing._chosen = spied
    for r in found:
        g = r.whole.given
        if g.size:
            lines.setdefault((r.source, g.line, g.prime, g.shift, g.words), []).append((g.start, g.size, r.whole.whole, r.ranges))
    assert len(lines) > 5
    for (_, line, prime, shift, words), parts in lines.items():
        parts.sort()
        assert [s for s, *_ in parts] == [sum(n for _, n, *_ in parts[:k]) for k in range(len(parts))] and sum(n for _, n, *_ in parts) == line
        blocks, rest, chosen = -(-line // 64), words % line, []
        order = sorted(range(blocks), key=lambda i: (i * (prime % blocks) + shift) % blocks)
        assert sorted((i * (prime % blocks) + shift) % blocks for i in range(blocks)) == list(range(blocks))
        for i in order:
            block = list(range(64 * i, min(64 * i + 64, line)))[: rest - len(chosen)]
            chosen += block
        chosen = set(chosen)
        assert len(chosen) == rest
        for start, size, whole, ranges in parts:
            assert whole == words // line and {start + k for x in ranges for k in range(x.begin, x.end)} == chosen & set(range(start, start + size))


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


# fingerprints


def tokens(text):
    return [t for w in WORD.findall(text or "") for t in (list(w) if len(w) > fingerprint.LONG else [w])]


def winnowed(hashes, window=4):
    """Places of the rightmost minimum of each window."""
    kept = []
    for i in range(max(1, len(hashes) - window + 1) if hashes else 0):
        part = hashes[i : i + window]
        at = i + max(k for k, h in enumerate(part) if h == min(part))
        if at not in kept:
            kept.append(at)
    return kept


def test_kept_grams_are_rightmost_minima(spark):
    texts = ["a b c d e f g h", "x x x x x x x x x x x", "one", " \n", "", "ein zwei drei vier " * 40, "ab" * 40, "漢字😀かな交じり文" * 12 + " x " + "q" * 24 + " y", "b a " * 30 + "z" * 25]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    every = fingerprint.with_fingerprint(df, "text", "f", window=1).select("i", F.col("f").alias("k"))
    some = fingerprint.with_fingerprint(df, "text", "f").select("i", F.col("f").alias("k"))
    grams = {r.i: [x.hash for x in r.k] for r in every.collect()}
    for r in some.collect():
        n = len(tokens(texts[r.i]))
        assert len(grams[r.i]) == (n + 3 if n else 0)
        assert [x.position for x in r.k] == winnowed(grams[r.i]) and all(x.hash == grams[r.i][x.position] for x in r.k)


def test_unspaced_texts_are_alike_after_an_edit(spark):
    rng = random.Random(2)
    long = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(450))
    docs = spark.createDataFrame([(0, long), (1, "前" + long), (2, "".join(rng.choice("abcdef") for _ in range(450)))], "doc_id long, text string")
    found = {r.doc_id: r for r in fingerprint.fingerprint_with_edits(docs).collect()}
    assert found[0].near_next > 0.95 and found[1].near_next < 0.05 and all(r.near_edited > 0.45 for r in found.values())
    assert any(len(x.split(":")[0]) == 16 for x in found[0].fingerprint.split())


def test_a_shared_passage_is_found(spark):
    passage = " ".join(f"p{i}" for i in range(7))
    df = spark.createDataFrame([(0, f"u v {passage} w x y"), (1, f"k {passage}"), (2, "none of it here at all but other words")], "i long, text string")
    sets = {r.i: set(r.h) for r in fingerprint.with_fingerprint(df, "text", "f").select("i", fingerprint.hashes("f").alias("h")).collect()}
    assert sets[0] & sets[1] and not sets[0] & sets[2]


_PRINTS = {}


def prints(spark, text):
    """The fingerprint of one text by itself; that its places are right is tested above."""
    if text not in _PRINTS:
        _PRINTS[text] = fingerprint.with_fingerprint(spark.createDataFrame([(text,)], "text string"), "text", "f").first().f
    return _PRINTS[text]


def alike(a, b):
    a, b = {x.hash for x in a}, {x.hash for x in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edits_and_neighbours(spark):
    texts = [" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 100), ("b", 3), ("c", 1), ("d", 400))] + [None, "", "ü😀é ö" * 5, "same text here", "same text here"]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("clash")).withColumn("head", F.lit(0))
    for per_range in (512, 2):
        found = {}
        ordered = fingerprint.with_next_text
        fingerprint.with_next_text = lambda d, n=per_range: ordered(d, n)
        try:
            found = {r.doc_id: r for r in fingerprint.fingerprint_with_edits(docs).collect()}
        finally:
            fingerprint.with_next_text = ordered
        assert sorted(found) == [i for i, _ in rows]
        for k, (i, t) in enumerate(rows):
            t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
            cut = len(t) // 4
            edited = t[: len(t) - cut] + after[:cut]
            r = found[i]
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            own, other, following = (prints(spark, x) for x in (t, edited, after))
            assert [f"{x.hash & 2**64 - 1:X}:{x.position}" for x in own] == r.fingerprint.split() and [f"{x.hash & 2**64 - 1:X}:{x.position}" for x in other] == r.edited_fingerprint.split()
            assert abs(r.near_edited - alike(own, other)) < 1e-12 and abs(r.near_next - alike(own, following)) < 1e-12
        assert found[21].fingerprint == found[24].fingerprint and found[21].near_next == 1.0
        assert found[0].near_edited > 0.4 > found[0].near_next and found[12].near_next == 1.0 and found[12].fingerprint == ""


def test_fingerprints_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprint.fingerprint_with_edits(none).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    assert fingerprint.fingerprint_with_edits(one).first().near_next == 1.0
    same = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "x"), (None, "y")], "doc_id long, text string")
    assert fingerprint.fingerprint_with_edits(same).count() == 4
