"""Each operator against a brute-force version on small tables, with nulls, ties, repeats and clashing columns."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from veilspark.llm import bytedup, chat, language, leaks, lines, nearcopies, pieces, pii, quality, queries, spans
from veilspark.llm.suffixes import suffix_order, suffix_orders

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, payload string, id string, h string, n_words string, band string"
FILLER = ["clash"] * 6
WORDS = "the of red blue tree house sky runs over under cat dog é日 123 a b c".split()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *FILLER) for i, t in rows], SCHEMA).repartition(3)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near-copies, shared passages, blanks and odd characters."""
    rng = random.Random(4)
    sentence = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    passage = sentence(70)
    rows = [(i, sentence(rng.randint(1, 90))) for i in range(40)]
    for i in range(40, 60):
        words = rows[i % 7][1].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(WORDS) + "x"
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(60 + i, sentence(9) + " " + passage + "\n" + sentence(9)) for i in range(6)]
    rows += [(70, None), (71, ""), (72, " \n\t "), (73, "one"), (74, "one"), (75, "One two"), (76, "x" * 300), (77, "a " * 400), (78, "\n\n\n"), (79, "ends 日"), (None, passage), (None, None)]
    return [*rows, rows[62], rows[5], rows[5], rows[71], rows[70], rows[43]]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return frame(spark, corpus)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


# 1


def naive_pii(text):
    text, out = text or "", []
    luhn = lambda d: sum((x if k % 2 == 0 else sum(map(int, str(2 * x)))) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@+-0123456789 ()é\n%_", max_size=60))
def test_pii_base_equals_patterns(text):
    found = [(x.kind, x.start, x.end) for x in pii.find(text) if x.kind in pii.KINDS[:4]]
    assert found == naive_pii(text)


def test_pii_kinds_and_scores():
    text = "mail me: jo.d+x@mail.example.org, IBAN GB82 WEST 1234 5698 7654 32 or GB82 WEST 1234 5698 7654 33; card 4111 1111-1111 1111, +1 (986) 555-4218 at 10.0.0.256 or 10.0.0.25 password=506fa6770ab87573ba"
    kinds = [(x.kind, text[x.start : x.end]) for x in pii.find(text)]
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in kinds and not any(v.endswith("33") for k, v in kinds if k == "iban")
    assert ("secret", "506fa6770ab87573ba") in kinds and ("ip", "10.0.0.25") in kinds and ("card", "4111 1111-1111 1111") in kinds
    assert [(x.kind, x.end) for x in pii.find("DE89 3704 0044 0532 0130 00 BANK")] == [("iban", 27)]
    near, far = pii.find("credit card 4111111111111111")[0], pii.find("order hash 4111111111111111")[0]
    assert near.score > far.score
    assert pii.find(None) == [] == pii.find("")


def test_pii_context_decides():
    code = "GB82 WEST 1234 5698 7654 32"
    kinds = lambda text: [x.kind for x in pii.find(text)]
    assert kinds(f"transfer to {code} now") == ["iban"] == kinds(code)
    assert kinds(f"sample {code}") == [] == kinds(f"{code} is a part") and kinds(f"sample account {code}") == ["iban"]
    assert kinds("sample" + " x" * 30 + f" {code}") == ["iban"]  # too far away
    plain, near, inner = (pii.find(f"{w} 10.0.0.25")[0].score for w in ("seen", "server", "description"))
    assert near > plain == inner
    assert pii.find("server x 10.0.0.25")[0].score > pii.find("server and then much later 10.0.0.25")[0].score
    assert kinds("token = abcdef12") == ["secret"] == kinds("private token = abcdef") and kinds("token = abcdef") == [] == kinds("an example: token = abcdef12")


def test_pii_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    parts = ["a.b@c.de", "10.0.0.25", "999.1.1.1", "4111 1111-1111 1111", "4111111111111112", "+1 (986) 555-4218", "GB82 WEST 1234 5698 7654 32", "token=abc123def", "é日", "and", "call"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(90, None), (91, ""), (None, parts[0]), (3, parts[1]), (92, "x " * 600_000 + parts[0])]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for i, text in rows:
        base = naive_pii(text)
        found = {(k, s, e) for k, s, e, _ in pii.find(text)}
        assert set(base) <= found
        spans = sorted(found, key=lambda x: (x[1], pii.KINDS.index(x[0]), x[2]))
        counts = [sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone")]
        expected.append((i, *counts, sha(",".join(f"{k}:{s}:{e}" for k, s, e in base)), ",".join(f"{k}:{s}:{e}" for k, s, e in spans)))
    got = queries.QUERIES["op1_pii"](spark, str(tmp_path)).drop("least_score").collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_pii_long_runs_are_linear():
    assert pii.find("1" * 300_000 + "." * 5) == []
    assert pii.find("a" * 300_000 + "@") == []
    assert len(pii.find("x@y.z " * 20_000)) == 20_000


def test_pii_long_secret(spark):
    value = "eyJhbGciOi9" * 400
    assert [(x.kind, x.start, x.end) for x in pii.find(f"token={value} end")] == [("secret", 6, 6 + len(value))]
    assert pii.find_pii(frame(spark, [(1, f"token={value} end")]), redact=True).first()["text"] == "token=<SECRET> end"
    assert len(pii.find("token=" * 50_000)) <= 1


def test_pii_table(spark, empty):
    rows = [(1, "call +1 (986) 555-4218 é a@b.c"), (1, "call +1 (986) 555-4218 é a@b.c"), (2, None), (None, "a@b.c")]
    found = pii.find_pii(frame(spark, rows), redact=True).collect()
    assert sorted(r["text"] for r in found if r["text"]) == ["<EMAIL>", "call <PHONE> é <EMAIL>", "call <PHONE> é <EMAIL>"]
    assert pii.find_pii(empty).count() == 0


# 2


def naive_leaks(rows, bench, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    phrases = {}
    for item, text in bench:
        if item is not None and text is not None and (ws := split(text)):
            for i in range(max(1, len(ws) - window + 1)):
                phrases.setdefault(tuple(ws[i : i + window]), set()).add(str(item))
    out = []
    for i, text in rows:
        ws, hit, items = split(text), set(), set()
        for size in {len(p) for p in phrases}:
            for k in range(len(ws) - size + 1):
                if owners := phrases.get(tuple(ws[k : k + size])):
                    hit |= set(range(k, k + size))
                    items |= owners
        out.append((i, len(ws), len(hit), tuple(sorted(items))))
    return out


def test_leaks(spark, docs, corpus, empty):
    rng = random.Random(5)
    long_text = [t for _, t in corpus if t and len(t.split()) > 30]
    bench = [(i, " ".join(rng.choice(long_text).split()[5 : 5 + rng.randint(1, 20)])) for i in range(12)] + [(99, None), (None, "one"), (3, "THE of red"), (50, "!!"), (51, "one")]
    table = spark.createDataFrame(bench, "item_id long, text string")
    expected = sorted(naive_leaks(corpus, bench), key=str)
    got = lambda df: sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in df.collect()), key=str)
    assert got(leaks.find_leaks(docs, table)) == expected
    again = [*corpus, *corpus[60:63], (61, "other text")]
    assert got(leaks.find_leaks(frame(spark, again), table, block_bytes=300)) == sorted(naive_leaks(again, bench), key=str)
    assert leaks.find_leaks(empty, table).count() == 0
    assert leaks.find_leaks(docs, table.where("false")).where("n_hit > 0").count() == 0


def test_leaks_proximity(spark):
    rows = frame(spark, [(1, "delta x alpha y beta"), (2, "alpha " + "x " * 30 + "beta delta"), (3, "alpha beta")])
    bench = spark.createDataFrame([("q", "alpha beta delta")], "item_id string, text string")
    assert {i: r["near_items"] for i, r in by_id(leaks.find_leaks(rows, bench, slop=5)).items()} == {1: ["q"], 2: [], 3: []}
    assert all(not r["items"] for r in by_id(leaks.find_leaks(rows, bench)).values())


def test_leaks_proximity_of_repeated_terms(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("a a b c r x x x y".split()) for _ in range(rng.randint(0, 25)))) for i in range(60)] + [(90, "a x r x a b"), (91, "r a b"), (92, "a b r b")]
    bench = [("one", "r a b"), ("two", "a r a"), ("three", "b b c a c"), ("four", "y"), ("five", "q a")]
    frames = frame(spark, rows), spark.createDataFrame(bench, "item_id string, text string")
    for slop in (2, 3, 6):
        expected = []
        for i, text in rows:
            words, hit, items = text.split(), set(), set()
            for item, phrase in bench:
                need = Counter(phrase.split())
                for s in range(len(words)):
                    if words[s] in need and need <= Counter(words[s : s + slop + 1]):
                        hit |= set(range(s, min(s + slop + 1, len(words))))
                        items.add(item)
            expected.append((i, len(hit), tuple(sorted(items))))
        near = lambda r: (r["doc_id"], sum(b - a for a, b in zip(r["near_starts"], r["near_ends"], strict=True)), tuple(r["near_items"]))
        for size in (leaks.BLOCK_BYTES, 20):
            found = leaks.find_leaks(*frames, slop=slop, block_bytes=size).collect()
            assert sorted(map(near, found)) == sorted(expected)
            assert sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found) == naive_leaks(rows, bench)
        assert slop != 3 or "one" in dict((i, x) for i, _, x in expected)[90]


# 3


@pytest.fixture(scope="module")
def models():
    path = pieces.model_path()
    with open(path, "rb") as f:
        return sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(f.read())


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80) | st.text(alphabet=" ▁ab\n1é日😀<0x>", max_size=60))
def test_pieces_equal_library(models, text):
    theirs, ours = models
    text = text.replace("\x00", "").encode("utf-8", "ignore").decode()
    ids = theirs.encode(text)
    assert ours.encode(text) == ids and ours.decode(ids) == theirs.decode(ids)
    proto = theirs.encode(text, return_type="proto")
    assert ours.encode_spans(text) == [(p.id, p.begin, p.end) for p in proto.pieces]


@settings(max_examples=200, deadline=None)
@given(ids=st.lists(st.integers(0, 31999) | st.integers(3, 258), max_size=12))
def test_pieces_decode_any_ids(models, ids):
    for some in (ids, [1, *ids], [28705, *ids], [2, 28705, *ids]):
        assert models[1].decode(some) == models[0].decode(some)


def trie_blob(rules):
    """A compiled character map with the given rules, its double array built node by node."""
    replacements, offsets = bytearray(), {}
    for source, target in rules.items():
        offsets[source.encode()] = len(replacements)
        replacements += target.encode() + b"\0"
    units, used, bases = {0: 0}, {0}, set()

    def place(node, prefix):
        labels = sorted({s[len(prefix)] for s in offsets if s.startswith(prefix) and len(s) > len(prefix)})
        leaf = prefix in offsets
        base = 1
        while base in bases or any((base ^ x) in used for x in [*labels, *([0] if leaf else [])]):
            base += 1
        bases.add(base)
        offset = base ^ node
        units[node] = units.get(node, 0) | (offset << 10) | (256 if leaf else 0)
        for x in labels:
            used.add(base ^ x)
            units[base ^ x] = x
        if leaf:
            used.add(base)
            units[base] = (1 << 31) | offsets[prefix]
        for x in labels:
            place(base ^ x, prefix + bytes([x]))

    place(0, b"")
    size = max(units) + 1
    array = b"".join(units.get(i, 0).to_bytes(4, "little") for i in range(size))
    return len(array).to_bytes(4, "little") + array + bytes(replacements)


def test_longest_rule_and_alignment(models):
    ours = pieces.PieceModel(open(pieces.model_path(), "rb").read())
    ours.charmap = pieces.CharMap(trie_blob({"ﬁ": "fi", "a": "A", "ab": "X", "abc": "long"}))
    assert ours.charmap.longest("abcd".encode(), 0) == (3, b"long") and ours.charmap.longest(b"ab", 0) == (2, b"X") and ours.charmap.longest(b"b", 0) is None
    text, source = ours.normalise("ﬁ abcd a")
    assert text == "▁fi▁longd▁A"
    assert source.tolist() == [0, 0, 0, 0, 0, 3, 3, 3, 4, 4, 4, 4, 7, 8, 8, 8, 9, 10] and len(source) == len(text.encode()) + 1
    spans = ours.encode_spans("ﬁ abcd a")
    assert spans[-1][2] == 10 and all(0 <= a <= b <= 10 for _, a, b in spans)


def number(n):
    return n.to_bytes(1, "little") if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)


def field(key, payload):
    return number(key << 3 | 2) + number(len(payload)) + payload


def with_rules(blob, rules, prefix, squeeze):
    """The model with the library's own normalisation rules of a name."""
    spec = sentencepiece.SentencePieceNormalizer(rule_name=rules).serialized_normalizer_spec()
    charmap = next((v for n, _, v in pieces._fields(spec) if n == 2), b"")
    kept = b"".join(field(n, v) if k == 2 else number(n << 3) + number(v) for n, k, v in pieces._fields(blob) if n != 3)
    return kept + field(3, field(2, charmap) + bytes([3 << 3, prefix, 4 << 3, squeeze, 5 << 3, 1]))


@pytest.mark.parametrize("rules", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize(("prefix", "squeeze"), [(1, 1), (1, 0), (0, 1)])
def test_pieces_with_rules_equal_library(rules, prefix, squeeze):
    rng = random.Random(rules)
    with open(pieces.model_path(), "rb") as f:
        blob = with_rules(f.read(), rules, prefix, squeeze)
    theirs, ours = sentencepiece.SentencePieceProcessor(model_proto=blob), pieces.PieceModel(blob)
    for _ in range(300):
        text = "".join(rng.choice([*" \t\n ab1ﬁＡé日①½ｶﾞ😀ﷺ▁x<>가", "\u3000", "\xa0", "\u200b", "e\u0301", "  "]) for _ in range(rng.randint(0, 25)))
        assert ours.encode_spans(text) == [(p.id, p.begin, p.end) for p in theirs.encode(text, return_type="proto").pieces], text
        assert ours.decode(ours.encode(text)) == theirs.decode(theirs.encode(text))


def test_squeezed_blanks():
    ours = pieces.PieceModel(open(pieces.model_path(), "rb").read())
    ours.squeeze = True
    assert ours.normalise("  a   b ")[0] == "▁a▁b"


def test_pieces_table(spark, docs, corpus, models, empty):
    expected = sorted(((i, len(models[0].encode(t or "")), sha(",".join(map(str, models[0].encode(t or "")))), sha(models[0].decode(models[0].encode(t or "")))) for i, t in corpus), key=str)
    assert sorted(map(tuple, pieces.digests(docs).collect()), key=str) == expected
    rows = pieces.tokenise(docs, spans=True).where("doc_id = 79").first()
    assert rows["ids"] == models[0].encode("ends 日") and rows["ends"][-1] == len("ends 日".encode())
    assert pieces.tokenise(empty).count() == 0


def test_pieces_query_and_stage_give_spans(spark, docs, corpus, models, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    theirs = [(str(i), [(p.id, p.begin, p.end) for p in models[0].encode(t or "", return_type="proto").pieces]) for i, t in corpus]
    packed = lambda spans: hashlib.sha256(b"".join(x[k].to_bytes(4, "little") for k in (1, 2) for x in spans)).hexdigest()
    rows = queries.QUERIES["op3_pieces"](spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["spans_sha256"]) for r in rows) == sorted((i, packed(x)) for i, x in theirs)
    rows = dict(corpus_pipeline.STAGES)["tokens"](spark, docs, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), list(zip(r["ids"], r["starts"], r["ends"], strict=True))) for r in rows) == sorted(theirs)
    assert sorted((str(r["doc_id"]), r["decoded_sha256"]) for r in rows) == sorted((i, sha(models[0].decode([y[0] for y in x]))) for i, x in theirs)


# 4


def naive_spans(rows, window=20):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first = {}
    known = [(i, split(t)) for i, t in rows if i is not None]
    for i, ws in known:
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k : k + window])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = []
    for i, t in rows:
        ws, gone = split(t), set()
        for k in range(len(ws) - window + 1 if i is not None else 0):
            if first[tuple(ws[k : k + window])] < (i, k):
                gone |= set(range(k, k + window))
        out.append((i, len(ws), len(gone), sha(" ".join(w for k, w in enumerate(ws) if k not in gone))))
    return sorted(out, key=str)


def test_spans(spark, docs, corpus, empty):
    got = lambda df: sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got(spans.remove_repeats(docs)) == naive_spans(corpus)
    assert got(spans.remove_repeats(docs, window=15, keep_text=True)) == naive_spans(corpus, 15)
    assert spans.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        spans.remove_repeats(docs, window=5)


def thue_morse(size):
    """A word and its complement; every polynomial hash modulo a power of two takes them for equal."""
    a, b = "a", "b"
    while len(a) < size:
        a, b = a + b, b + a
    return a, b


def test_hashes_tell_regular_words_apart():
    import numpy as np

    from veilspark.llm import _text

    a, b = thue_morse(1024)
    data = np.frombuffer((a + b).encode(), np.uint8)
    for hashes in _text.over_bytes(data).pair(np.array([0, 1024]), np.array([1024, 2048])):
        assert hashes[0] != hashes[1]
    again = np.frombuffer(("xy" + a + "z" + a).encode(), np.uint8)
    one, two = _text.over_bytes(again).of(np.array([2, 1027]), np.array([1026, 2051]))
    assert one == two


def test_spans_of_rows_that_share_an_id_and_of_regular_words(spark):
    w, u = " ".join(f"w{i}" for i in range(40)), " ".join(f"u{i}" for i in range(40))
    a, b = thue_morse(1024)
    words = [f"x{i}" for i in range(25)]
    rows = [(0, w), (1, u), (1, w), (1, w), (2, u + " end"), (2, "begin " + u), (5, " ".join([*words[:12], a, *words[12:]])), (6, " ".join([*words[:12], b, *words[12:]])), (7, " ".join(words * 3))]
    got = sorted(map(tuple, spans.remove_repeats(frame(spark, rows), bucket_bytes=100).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got == naive_spans(rows)
    assert [r[2] for r in got if r[0] == 1] == [0, 40, 40]


def test_long_texts(spark):
    rng = random.Random(12)
    sentence = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))
    body = sentence(260_000)  # beyond a block of 1 MB
    assert len(body.encode()) > 1 << 20
    rows = [(1, body), (2, sentence(30) + " " + body + " " + sentence(30)), (3, body[5000:9000]), (4, body + "\n" + body[:3000])]
    df = frame(spark, rows)
    got = lambda out, *names: sorted(tuple(r[n] for n in names) for r in out.collect())
    assert got(spans.remove_repeats(df), "doc_id", "n_words", "n_removed", "kept_sha256") == naive_spans(rows)
    assert got(bytedup.remove_bytes(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == naive_bytes(rows)
    assert got(nearcopies.near_copies(df), "doc_id", "n_shingles", "component_id", "kept") == naive_near(rows)
    bench = [("a", " ".join(body.split()[100_000:100_012])), ("b", "zz yy")]
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in leaks.find_leaks(df, spark.createDataFrame(bench, "item_id string, text string")).collect()) == naive_leaks(rows, bench)


def test_difference_cover():
    assert {(a - b) % spans.PERIOD for a in spans.COVER for b in spans.COVER} == set(range(spans.PERIOD))


# 5


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = queries.QUERIES["op5_language"](spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 20 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)


def test_language_learns_only_from_rows_it_may(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "train", lambda texts, langs: seen.append(sorted(zip(texts, langs, strict=True))))
    text = lambda i: f"word{i} and so on"
    rows = [(i, text(i), "en" if i % 2 else "de") for i in range(300)] + [(None, "no id", "en"), (1000, None, "en"), (1001, "no lang", None), (1002, "x" * 100_001, "en")]
    rows += [(i, text(i), "en" if i % 2 else "de") for i in range(0, 300, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    language.fit(docs, rows=100_000)
    every = sorted((text(i), "en" if i % 2 else "de") for i in range(300) if zlib.crc32(str(i).encode()) % 4 != 2)
    assert set(seen[0]) <= set(every) and len(seen[0]) == len(set(seen[0])) > 0.98 * len(every)
    language.fit(docs, rows=50)
    assert 20 < len(seen[1]) <= 50 and set(seen[1]) <= set(every)
    monkeypatch.setattr(language, "TRAIN_BYTES", 100)
    language.fit(docs, rows=100_000)
    assert sum(len(t) for t, _ in seen[2]) <= 100


def test_language_of_words_in_mixed_text(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null").select("text", "lang").collect()
    model = language.train([r["text"] for r in rows], [r["lang"] for r in rows])
    tagged = model.tag("the of and is with that. Der und die nicht auf das ein")
    assert [x[1] for x in tagged[:6]] == ["en"] * 6 and [x[1] for x in tagged[-6:]] == ["de"] * 6
    off = model.change.diagonal().min() - (model.change - 1e9 * (model.change == model.change.diagonal())).max()
    assert off > 0


def test_forward_backward_equals_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    e, change, begin = rng.random((9, 3)) + 0.1, rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    at = np.array([0, 5, 5, 6, 9])
    p = language.forward_backward(e, change, begin, at, piece=2)[0]
    for lo, hi in ((0, 5), (5, 6), (6, 9)):
        total = np.zeros((hi - lo, 3))
        for path in itertools.product(range(3), repeat=hi - lo):
            w = begin[path[0]] * np.prod([e[lo + k, s] for k, s in enumerate(path)]) * np.prod([change[a, b] for a, b in itertools.pairwise(path)])
            for k, s in enumerate(path):
                total[k, s] += w
        assert np.allclose(p[lo:hi], total / total.sum(1, keepdims=True))


def test_language_edges(spark, docs, empty):
    model = language.train(["the cat the", "der hund der"] * 5, ["en", "de"] * 5)
    out = {}
    for r in language.identify(docs, model).collect():
        out.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert out[70] == [("und", 0.0)] == out[71] == out[72] and out[73][0][0] in ("en", "de") and len(out[None]) == 2
    assert language.train([], []) is None and {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(empty, model).count() == 0
    assert language.fit(docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang is null")) is None


# 6


def naive_near(rows, shingle=5, percent=75):
    sets = []
    for _, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(ws[k : k + shingle]) for k in range(max(1, len(ws) - shingle + 1))} if ws else set())
    label = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for (i, _), a in zip(rows, sets, strict=True):
            for (j, _), b in zip(rows, sets, strict=True):
                if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return sorted(((i, len(s), label[i] if i is not None else None, i is None or label[i] == i) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def test_near_copies(spark, docs, corpus, empty, monkeypatch):
    got = lambda df: sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got(nearcopies.near_copies(docs)) == naive_near(corpus)
    assert nearcopies.near_copies(empty).count() == 0
    monkeypatch.setattr(nearcopies, "BLOCK_ROWS", 3)
    assert got(nearcopies.near_copies(docs)) == naive_near(corpus)


def test_near_copies_in_chains_and_blocks(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in range(rng.choice([0, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    chain = list(base)
    for i in range(60, 90):
        chain = [*chain[3:], f"c{i}a", f"c{i}b", f"c{i}c"]
        rows.append((i, " ".join(chain)))
    monkeypatch.setattr(nearcopies, "BLOCK_ROWS", 7)
    got = sorted(map(tuple, nearcopies.near_copies(frame(spark, rows)).collect()), key=str)
    assert got == naive_near(rows)


def test_components_dealt_out_equal_one_task(spark, monkeypatch):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(45)] + [(500, 500 + k) for k in range(1, 90)] + [(700, 699), (699, 701)]
    links = spark.createDataFrame([(max(e), min(e)) for e in edges if e[0] != e[1]], "a long, b long").repartition(5)
    here = sorted(map(tuple, nearcopies.components(links).collect()))
    monkeypatch.setattr(nearcopies, "LOCAL_LINKS", 0)
    assert sorted(map(tuple, nearcopies.components(links).collect())) == here
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert here == sorted((x, r) for x, r in label.items() if x != r)


def test_superminhash_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**63, 900, dtype=np.int64).astype(np.uint64)
    row = np.repeat([0, 1], [600, 600])
    sig = nearcopies.signatures(row, np.concatenate([hashes[:600], hashes[300:]]), 2, 512)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.07
    one = nearcopies.signatures(np.array([0]), hashes[:1], 1, 128)
    assert sorted((one[0] >> np.uint64(32)).tolist()) == list(range(128))


# 7


def naive_rules(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    parts = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)]
    twice = {k for k, w in enumerate(windows) if windows.count(w) > 1}
    covered = {j for k in twice for j in range(k, k + 5)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(parts) - len(set(parts)), len(covered)


def test_quality_base(spark, docs, corpus, empty):
    rows = [*corpus, (200, "a b c d e\na b c d e\n\n \n \na|b #"), (201, "x\nx\r\nx\n")]
    stats = quality.rule_stats(frame(spark, rows))
    got = sorted((tuple(r[:6]) for r in stats.collect()), key=str)
    assert got == sorted(((i, *naive_rules(t)) for i, t in rows), key=str)
    out = quality.quality(frame(spark, rows), None)
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and r["kept"] == (not r["base_failed"]) for r in out.collect())
    assert quality.quality(empty, None).count() == 0


def test_quality_forest(spark, sf):
    out = queries.QUERIES["op7_quality"](spark, sf)
    marked = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in marked if r["quality"] == 1], [r for r in marked if r["quality"] == 0]
    assert sum(r["kept"] for r in good) / len(good) > 0.9 and sum(r["kept"] for r in bad) / max(1, len(bad)) < 0.4
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = quality.filter_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in out.where("kept").collect()}


def test_quality_verdict_equals_its_rules(spark, sf):
    """The query's verdict from the naive base rules and the forest's score of every row by itself; held-out labels."""
    import numpy as np

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    forest = quality.fit(quality.rule_stats(docs), labels)
    features = {r["doc_id"]: np.array([r["features"]]) for r in quality.rule_stats(docs).collect()}
    rows = queries.QUERIES["op7_quality"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        n_words, chars, symbols, lines_, repeats = naive_rules(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n_words, chars, symbols, lines_, repeats)
        failed = n_words < 10 or 100 * repeats > 20 * n_words
        assert r["base_failed"] == failed and r["kept"] == (not failed and forest.score(features[r["doc_id"]])[0] <= forest.threshold)
    kept, caught, good, bad = forest.held_out
    assert good + bad > 0 and kept > 0.8


def test_quality_is_fitted_on_the_whole_table(spark):
    """Trees draw from all documents, and every labelled row counts in the threshold."""
    import numpy as np

    n = 24_000
    odd = "case when id % 10 = 0 then 1 else 0 end"
    numbers = ", ".join(f"cast(pmod(xxhash64(id, {k}L), 1000) as double) / 1000 + {odd}" for k in range(1, len(quality.FEATURES)))
    stats = spark.range(n).selectExpr("id doc_id", "100L n_words", "0L n_repeat_words", f"array(cast(id as double) / {n}, {numbers}) features")
    labels = stats.selectExpr("doc_id", "cast(pmod(doc_id, 10) > 0 as int) quality")
    forest = quality.fit(stats, labels)
    kept, caught, good, bad = forest.held_out
    held = stats.selectExpr("pmod(xxhash64(doc_id, 2), 4) = 0 out", "doc_id % 10 > 0 good").where("out").collect()
    assert (good, bad) == (sum(r["good"] for r in held), sum(not r["good"] for r in held))
    assert kept > 0.99 and caught > 0.99
    assert len(forest.trees) == quality.TREES and forest.size == quality.SAMPLE
    drawn = quality._subsamples(stats, 2 * quality.SAMPLE / n).collect()
    trees = {}
    for r in sorted(drawn, key=lambda r: r["hash"]):
        trees.setdefault(r["tree"], []).append(round(r["features"][0] * n))
    used = [set(ids[: quality.SAMPLE]) for ids in trees.values()]
    assert all(len(x) == quality.SAMPLE for x in used) and len(set().union(*used)) > n // 2
    # The best cut of all labelled rows that are not held out, row by row.
    rows = stats.selectExpr("features", "doc_id % 10 > 0 good", "pmod(xxhash64(doc_id, 2), 4) = 0 out").where("not out").collect()
    scores, fine = forest.score(np.array([r["features"] for r in rows])), np.array([r["good"] for r in rows])
    worth = lambda c: (scores[~fine] > c).sum() - quality.GOOD_COST * (scores[fine] > c).sum() * (~fine).sum() / fine.sum()
    assert worth(forest.threshold) == max(worth(c) for c in np.unique(np.ceil(scores * quality.BINS) / quality.BINS))


def test_isolation_forest_finds_the_odd_rows():
    import numpy as np

    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(size=(500, 4)), rng.normal(8, 1, size=(5, 4))])
    scores = quality.Forest(rows).score(rows)
    assert set(np.argsort(scores)[-5:]) == set(range(500, 505)) and (scores > 0).all() and (scores < 1).all()


# 8


def naive_lines(rows, windows=(1, 1, 1, 1, 1, 2)):
    chunked = []
    for i, t in rows:
        parts = t.split("\n") if t is not None else []
        h = [int(hashlib.md5(x.encode()).hexdigest()[:15], 16) for x in parts]
        found = set()
        for level, window in enumerate(windows):
            begin = 0
            for k in range(len(parts)):
                rolled = 0
                for back in range(min(window, k + 1)):
                    rolled ^= h[k - back] << back
                if k == len(parts) - 1 or (rolled >> (20 + level)) % 2 == 0:
                    if k > begin:
                        found.add((begin, tuple(parts[begin : k + 1])))
                    begin = k + 1
        chunked.append((i, t, parts, found))
    first = {}
    for i, _, _, found in chunked:
        for k, c in found:
            if i is not None:
                first[c] = min(first.get(c, (i, k)), (i, k))
    out = []
    for i, t, parts, found in chunked:
        gone = {x for k, c in found if i is not None and first[c] < (i, k) for x in range(k, k + len(c))}
        out.append((i, None if t is None else "\n".join(x for k, x in enumerate(parts) if k not in gone), len(parts), len(gone)))
    return sorted(out, key=str)


def test_lines(spark, empty):
    rng = random.Random(6)
    pool = [f"line {k} {'x' * (k % 5)}" for k in range(25)] + ["", "é"]
    block = [rng.choice(pool) for _ in range(14)]
    rows = [(i, "\n".join([*(rng.choice(pool) for _ in range(rng.randint(0, 6))), *(block if i % 3 == 0 else []), *(rng.choice(pool) for _ in range(rng.randint(0, 9)))])) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "\n"), (53, "\n"), (None, rows[0][1]), (54, rows[3][1]), (3, rows[3][1]), (55, "\n".join(block * 2)), (56, "\n".join(block * 2)), (56, "\n".join(block * 2))]
    df = frame(spark, rows)
    out = lines.remove_repeated_chunks(df)
    assert [c for c in out.columns if c not in ("n_lines", "n_removed")] == df.columns
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()), key=str) == naive_lines(rows)
    assert sum(r["n_removed"] for r in out.collect()) > 20
    assert lines.remove_repeated_chunks(empty).count() == 0


def test_lines_keep_columns_of_their_names(spark):
    rows = spark.createDataFrame([(1, "a\nb\nc\nd", "x", 7, 9), (2, "a\nb\nc\nd", "y", 8, 3)], "doc_id long, text string, n_removed string, n_lines long, n_lines_ long")
    out = by_id(lines.remove_repeated_chunks(rows))
    assert [(out[i]["n_removed"], out[i]["n_lines"], out[i]["n_lines_"]) for i in (1, 2)] == [("x", 7, 9), ("y", 8, 3)]
    assert [out[i]["n_lines__"] for i in (1, 2)] == [4, 4] and out[1]["n_removed_"] == 0 < out[2]["n_removed_"]


def test_lines_of_planted_passages(spark):
    """Most lines of passages that stand between different neighbours go, and one copy of each stays."""
    rng = random.Random(7)
    line = lambda: " ".join(rng.choice(WORDS) + str(rng.randrange(1000)) for _ in range(13))
    rows, passages = [], {}
    for size in (4, 6, 8, 12):
        for _ in range(60):
            passage = [line() for _ in range(size)]
            for _ in range(2):
                passages[len(rows)] = passage
                rows.append((len(rows), "\n".join([*(line() for _ in range(5)), *passage, *(line() for _ in range(5))])))
    out = by_id(lines.remove_repeated_chunks(frame(spark, rows)))
    for size, least in ((4, 0.55), (6, 0.7), (8, 0.8), (12, 0.85)):
        lost = sum(out[i]["n_removed"] for i, p in passages.items() if len(p) == size)
        assert least < lost / 60 / size < 1
    for i, p in passages.items():
        assert sum(x in out[j]["text"] for j in (i - i % 2, i - i % 2 + 1) for x in p) >= len(p) and out[i]["n_removed"] <= len(p)
    assert all(out[i]["n_removed"] == 0 for i in passages if i % 2 == 0)


def test_lines_run_no_python(spark, docs):
    plan = lines.remove_repeated_chunks(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 9


def naive_bytes(rows, size=50):
    first = {}
    coded = [(i, (t or "").encode()) for i, t in rows]
    for i, b in coded:
        for k in range(len(b) - size + 1 if i is not None else 0):
            first[b[k : k + size]] = min(first.get(b[k : k + size], i), i)
    out = []
    for i, b in coded:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1 if i is not None else 0):
            if first[b[k : k + size]] < i:
                gone[k : k + size] = b"\1" * size
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return sorted(out, key=str)


def test_bytes(spark, docs, corpus, empty, monkeypatch):
    got = lambda df: sorted((tuple(r)[:5] for r in df.collect()), key=str)
    assert got(bytedup.remove_bytes(docs)) == naive_bytes(corpus)
    assert got(bytedup.remove_bytes(docs, length=20, gram=8, keep_text=True)) == naive_bytes(corpus, 20)
    assert got(bytedup.remove_bytes(docs, length=12, gram=12)) == naive_bytes(corpus, 12)
    assert bytedup.remove_bytes(empty).count() == 0
    periodic = [(1, "ab" * 60), (2, "x" + "ab" * 45 + "y"), (3, "aaab" * 30), (4, "b" * 130), (5, "cb" + "b" * 90)]
    assert got(bytedup.remove_bytes(frame(spark, periodic))) == naive_bytes(periodic)


def test_bytes_of_hot_keys_in_many_buckets(spark, docs, corpus, monkeypatch):
    got = lambda df: sorted((tuple(r)[:5] for r in df.collect()), key=str)
    rng = random.Random(3)
    phrase = "a phrase that stands in many places"
    rows = [(i, "".join(rng.choice("abcdefg ") for _ in range(30)) + phrase + rng.choice(["x" * 30, "y" * 9 + "z" * 40, str(i) * 20])) for i in range(200)]
    for hot in (0, 3, 50):
        monkeypatch.setattr(bytedup, "HOT", hot)
        assert got(bytedup.remove_bytes(frame(spark, rows), bucket_bytes=600)) == naive_bytes(rows)
    monkeypatch.setattr(bytedup, "HOT", 1)
    assert got(bytedup.remove_bytes(docs)) == naive_bytes(corpus)


def test_bytes_are_decided_by_the_suffix_order(monkeypatch):
    import numpy as np

    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(20, 90))) for _ in range(60)]
    texts += [*texts[:10], *texts[:10]]
    docs = [rng.randrange(1000) for _ in texts]
    units = np.array([0, 5, 6, 40, 80])
    given_ = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), np.array(docs), units
    expected = []
    for lo, hi in zip(units[:-1], units[1:], strict=True):
        for i in range(lo, hi):
            expected += [min(d for t, d in zip(texts[lo:hi], docs[lo:hi], strict=True) if texts[i][k : k + 20] in t) for k in range(len(texts[i]) - 19)]
    assert bytedup.least_documents(*given_, 20).tolist() == expected
    one = (*given_[:3], np.array([0, 80]))
    together = bytedup.least_documents(*one, 20)
    for k, (t, at) in enumerate(zip(texts, np.cumsum([len(t) - 19 for t in texts]), strict=True)):
        assert together[at - len(t) + 19 : at].tolist() == [min(d for x, d in zip(texts, docs, strict=True) if t[j : j + 20] in x) for j in range(len(t) - 19)], k
    # All records of a key, copies beyond the second included, through the runs.
    keys = np.sort(np.array([rng.randrange(9) for _ in texts], np.uint64))
    for together_ in (0, 48, 10**9):
        monkeypatch.setattr(bytedup, "TOGETHER", together_)
        record, least, begin, end, _ = bytedup._string_documents(keys, given_[2], given_[1], given_[0], 20)
        got = {}
        for r, d, lo, hi in zip(record.tolist(), least.tolist(), begin.tolist(), end.tolist(), strict=True):
            got.setdefault(r, []).extend([d] * (hi - lo))
        for r, t in enumerate(texts):
            assert got[r] == [min(d for x, d, k in zip(texts, docs, keys, strict=True) if k == keys[r] and t[j : j + 20] in x) for j in range(len(t) - 19)]
    monkeypatch.setattr(bytedup, "suffix_orders", lambda codes, starts: np.arange(len(codes)))
    assert bytedup.least_documents(*given_, 20).tolist() != expected


def test_a_heavy_key_is_sorted_in_small_units(monkeypatch):
    """Many different stretches of one key, of unlike and of equal strings, periodic ones too: right answers, and no sort grows with their number."""
    import numpy as np

    rng = random.Random(4)
    phrase = "a passage that stands in many places of the corpus, word by word"
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = [(noise(rng.randint(0, 20)) + rng.choice([phrase, phrase[:30], "ab" * rng.randint(15, 40), "a" * 40]) + noise(rng.randint(20, 30))).encode() for _ in range(1500)]
    texts += texts[:200]
    keys, docs = np.sort(np.array([rng.randrange(3) for _ in texts], np.uint64)), np.array([rng.randrange(900) for _ in texts])
    sizes, text, length = np.array([len(t) for t in texts]), np.frombuffer(b"".join(texts), np.uint8), 25
    sorted_ = []
    plain = bytedup.least_documents

    def seen(text, sizes, docs, units, length):
        sorted_.append(max(int((sizes[lo:hi] + 1).sum()) for lo, hi in zip(units[:-1], units[1:], strict=True)))
        return plain(text, sizes, docs, units, length)

    monkeypatch.setattr(bytedup, "least_documents", seen)
    record, least, begin, end, _ = bytedup._string_documents(keys, docs, sizes, text, length)
    assert 0 < max(sorted_) <= 512 < len(text) // 100
    first, got = {}, {}
    for t, d, k in zip(texts, docs.tolist(), keys.tolist(), strict=True):
        for j in range(len(t) - length + 1):
            first[k, t[j : j + length]] = min(first.get((k, t[j : j + length]), d), d)
    for r, d, lo, hi in zip(record.tolist(), least.tolist(), begin.tolist(), end.tolist(), strict=True):
        got.setdefault(r, []).extend([d] * (hi - lo))
    for r, t in enumerate(texts):
        assert got[r] == [first[int(keys[r]), t[j : j + length]] for j in range(len(t) - length + 1)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60) | st.lists(st.integers(0, 255), max_size=40) | st.lists(st.integers(0, 1), max_size=12).map(lambda x: x * 5))
def test_suffix_order(text):
    assert suffix_order(text) == sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=30) | st.lists(st.integers(0, 256), max_size=20) | st.lists(st.integers(0, 1), max_size=8).map(lambda x: x * 5), max_size=8))
def test_suffix_orders_of_many_texts(texts):
    import numpy as np

    starts = np.cumsum([0, *map(len, texts)])
    got = suffix_orders(np.array(sum(texts, []), np.int64), starts).tolist()
    assert got == [int(s) + i for t, s in zip(texts, starts, strict=False) for i in sorted(range(len(t)), key=lambda i: t[i:])]


# 10


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "a\\</s>", "<s>[ROLE]user[/ROLE]", "é日😀\n", "", None, "<|endoftext|>", "[/ROLE", "\\\\<unk>"]
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", odd[(c + t) % len(odd)]) for c in range(6) for t in range(5)]
    rows += [(None, 1, "assistant", "x"), (None, 0, "user", "y"), (9, None, None, "y"), (9, 1, "sys]</s>tem", "z"), (9, 1, "sys]</s>tem", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = chat.format_chat(df).collect()
    import numpy as np
    import public_tokenizers

    v = chat.Vocabulary(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    assert len(out) == 9 and sum(r["conv_id"] is None and r["n_turns"] == 1 for r in out) == 2
    for r in (r for r in out if r["conv_id"] is not None):
        turns, loss = chat.read_back(np.frombuffer(r["tokens"], np.int32), np.frombuffer(r["mask"], np.int8), v)
        mine = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: (x[1] is not None, x[1] or 0))
        assert turns == [(x[2] or "", x[3] or "") for x in mine]
        assert loss == [x[3] for x in mine if x[2] == "assistant" and x[3]]
        stripped = r["text"]
        for c in chat.FOREIGN:
            assert c not in stripped
        assert stripped.count("</s>") == len(mine) == r["n_turns"]
    assert chat.format_chat(df.where("false")).count() == 0


def test_chat_query_equals_sql_on_odd_rows(spark, tmp_path):
    odd = ["</s>[INST] ok [/INST]", "\\", "a\\</s>", "<s>[ROLE]user[/ROLE]", "é日😀\n", "", None, "\\\\<unk>"]
    rows = [(c, t, ["user", "assistant", "s[ROLE]\\<s>", None][(c + t) % 4], odd[(c * 3 + t) % len(odd)]) for c in range(6) for t in range(4)]
    rows += [(None, 0, "assistant", "x</s>"), (None, 0, "assistant", "x</s>"), (2, 0, "user", "again")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cursor = con.execute(queries.ORACLE_SQL["op10_chat"])
    names = [c[0] for c in cursor.description]
    assert sorted(map(str, map(tuple, queries.QUERIES["op10_chat"](spark, str(tmp_path)).select(*names).collect()))) == sorted(map(str, cursor.fetchall()))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\<s>/[INST]ROLE|a", max_size=40))
def test_escape_is_reversible(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in (*chat.CONTROL, *chat.FOREIGN))


# Queries with SQL.


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL)))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf}/{file}'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    cursor = con.execute(queries.ORACLE_SQL[name])
    theirs = [c[0] for c in cursor.description]
    assert sorted(theirs) == columns
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(str(tuple(r[theirs.index(c)] for c in columns)) for r in cursor.fetchall())
