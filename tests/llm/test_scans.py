"""Secrets, licenses, toxicity, language, encoding."""

import hashlib
import re

import numpy as np

from cases import collect, docs, rows
from taffeta.llm import bpe, language, licenses, secrets, toxicity


def test_base_secrets_against_plain_patterns(spark):
    got = collect(secrets.summary(secrets.scan(docs(spark).select("doc_id", "text"))))
    want = []
    for r in rows():
        t, found = r[1] or "", []
        pattern = r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        found += [(m.start(), 0, "assign", m.end()) for m in re.finditer(pattern, t) if len(m[2]) >= 12]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        listed = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))
        want.append((r[0], *[sum(f[2] == k for f in found) for k in ("assign", "access", "hex")], hashlib.sha256(listed.encode()).hexdigest()))
    mine = [(g["doc_id"], g["n_assign"], g["n_access"], g["n_hex"], g["base_sha256"]) for g in got]
    assert sorted(mine, key=str) == sorted(want, key=str)
    assert any("guess:" in g["spans"] for g in got)


def test_base_patterns_at_their_edges():
    kinds = lambda t: [s[:3] for s in secrets.spans(t) if s[0] != "guess"]
    assert kinds("secret: token: abcdefghijklmnop") == []  # the failing match takes the second word
    assert kinds("API_KEY='abcdefghijkl'") == [("assign", 0, 21)]
    assert kinds("paſsword=abcdefghijklmnop") == []  # only A-Z in either case
    assert kinds("AKIA" + "A" * 13) == [] and kinds("AKIA" + "A" * 14) == [("access", 0, 18)]


def test_guess_costs_rank_values():
    cost = secrets.guess_cost
    assert cost("password") < cost("p@ssword") < cost("xK9#mQ2v") and cost("qwertyuiop") < 4 and cost("aaaaaaaaaaaa") < 4
    assert cost("2019-12-31") < 6 and cost("abcabcabcabc") < cost("abqxzvkwpjfm") and cost("") == 0


def test_license_places_against_brute_force(spark):
    got = collect(licenses.summary(licenses.scan(docs(spark))))
    want = []
    for r in rows():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", licenses.ascii_lower(r[1] or ""))
        at = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
        want.append((r[0], len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    mine = [(g["doc_id"], g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) for g in got]
    assert sorted(mine, key=str) == sorted(want, key=str)
    row = next(g for g in got if g["doc_id"] == 16)
    assert row["labels"] == "cc-by,cc-by-nc-4.0,gpl,gpl-3.0,reserved" and 0 < row["score"] <= 1


def test_rules_that_overlap_leave_the_first_in_order():
    found = licenses.detect("spdx-license-identifier: gpl-2.0-or-later; apache license, version 2.0")
    assert [d[0] for d in found] == ["gpl-2.0-or-later", "apache-2.0"] and len(licenses.rules()) > 300
    assert licenses.detect("") == []


def test_restored_text():
    clean = "the idiot was a moron and the scum of the earth said so that it is stupid " * 40
    raw = np.frombuffer(("  " + clean).encode(), np.uint8)
    c = toxicity._CLASS[raw]
    model = toxicity.CharacterModel(np.bincount(c[:-2] * 784 + c[1:-1] * 28 + c[2:], minlength=28 ** 3))
    texts = ["an 1d10t", "IDIOOOOT!", "i d i o t", "m.o.r.o.n", "$cum", "clean words stay, Off 3!", None, "call 555-1234"]
    assert toxicity.restore_texts(texts, model) == ["an idiot", "idiot!", "idiot", "moron", "scum", "clean words stay, Off 3!", "", "call 555-1234"]


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(spark, d, labels)
    scored = toxicity.score(d, model).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0")
    got = [(r["toxic"], r["score"]) for r in scored.collect()]
    pos, neg = [s for t, s in got if t == 1], [s for t, s in got if t == 0]
    assert np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.9
    edge = collect(toxicity.score(docs(spark), model))
    assert len(edge) == len(rows()) and all(0 <= r["score"] <= 1 for r in edge)
    assert collect(toxicity.score(docs(spark, empty=True), model)) == []


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(spark, docs(spark), none)
    assert {round(r["score"], 3) for r in collect(toxicity.score(docs(spark), model))} == {0.25}


def test_encoding_is_the_librarys(spark):
    import public_tokenizers as P
    import tiktoken
    path = P.path("byte_bpe_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = collect(bpe.encode(docs(spark), path, P.PATTERN))
    assert len(got) == len(rows())
    for g in got:
        assert g["ids"] == encoding.encode_ordinary(g["text"] or "") and bytes(g["decoded"]) == (g["text"] or "").encode()
    back = collect(bpe.decode(bpe.encode(docs(spark), path, P.PATTERN), path, P.PATTERN))
    assert all(bytes(b["decoded"]) == (b["text"] or "").encode() for b in back)
    assert collect(bpe.encode(docs(spark, empty=True), path, P.PATTERN)) == []


def test_what_was_forgotten_is_coded_again():
    import public_tokenizers as P
    import tiktoken
    path = P.path("byte_bpe_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    c = bpe.Coder(path, P.PATTERN)
    c.chunk_codes, c.piece_codes = bpe.Remembered(5), bpe.Remembered(5)
    texts = [r[1] or "" for r in rows()] + ["don't  stop 12345 \n\n\t x", "漢字 😀😀!", ""]
    for turn in range(3):
        for at in range(0, len(texts), 4):
            some = texts[at:at + 4]
            ids, sizes, decoded = c.put_together([c.chunks(t) if t else [] for t in some])
            ends = np.cumsum([0, *sizes])
            assert [ids[i:j].tolist() for i, j in zip(ends, ends[1:])] == [encoding.encode_ordinary(t) for t in some]
            assert decoded == [t.encode() for t in some]


def test_a_block_is_cut_and_looked_up_as_one():
    """Chunks are cut together and are not remembered beside their pieces."""
    import public_tokenizers as P
    import tiktoken
    path = P.path("byte_bpe_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    c = bpe.Coder(path, P.PATTERN)
    found, cut = [], c.find
    c.find = lambda text: found.append(text) or cut(text)
    plain = [" ".join(f"w{i}x{j}, don't\ncaf\u00e9{i}." for i in range(50)) for j in range(40)]
    c.put_together([c.chunks(t) for t in plain])
    assert len(found) <= 2 + len(plain)
    assert set(c.piece_codes.ids) == {p for t in plain for p in cut(t)}
    odd = [" lead", "trail ", " ", "\n", "a  b", "a\u00a0 b", "\u3000x y\u3000", "x\x1c y", "a\0 b \0", " \0", "tab\t end\n\n\n x", "it's 'll 12 \u00b2\u2167", "", None, "\u6f22\u5b57 \U0001f600!"]
    for texts in (odd, plain + odd, odd[::-1], [None, ""], []):
        chunks, at = c.cut(texts)
        assert [chunks[int(i):int(j)].to_pylist() for i, j in zip(at[:-1], at[1:])] == [c.chunks(t) if t else [] for t in texts]
        ids, sizes, decoded = c.code(chunks, at)
        ends = np.cumsum([0, *sizes])
        assert [ids[i:j].tolist() for i, j in zip(ends[:-1], ends[1:])] == [encoding.encode_ordinary(t or "") for t in texts]
        assert decoded == [(t or "").encode() for t in texts]


def test_encoding_with_little_memory_is_the_same(spark, monkeypatch):
    import corpus_pipeline
    import public_tokenizers as P
    path = P.path("byte_bpe_50k.tiktoken")
    assert (bpe.coder(path, P.PATTERN, 20).piece_codes.limit, bpe.coder(path, P.PATTERN).piece_codes.limit) == (20, bpe.PIECES)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    little, much = (sorted(collect(bpe.encode(docs(spark), path, P.PATTERN, **x)), key=key) for x in ({"remembered": 20, "block_chars": 500}, {}))
    assert little == much
    asked, whole = {}, bpe.encode
    monkeypatch.setattr(bpe, "encode", lambda *a, **b: asked.update(b) or whole(*a, **b))
    assert all(r["round_trip"] for r in collect(corpus_pipeline.encode(spark, docs(spark), "")))
    assert asked["remembered"] <= bpe.PIECES // 2 and asked["block_chars"] <= bpe.BLOCK_CHARS // 2


def test_a_lean_function_gives_all_batches_then_memory_back(monkeypatch):
    from taffeta.llm import batches
    trimmed = []
    library = type("Library", (), {"malloc_trim": staticmethod(trimmed.append)})
    monkeypatch.setattr(batches.ctypes, "CDLL", lambda name: library)
    out = batches.lean(lambda xs: (x + 1 for x in xs))(iter([1, 2]))
    assert [next(out), next(out), trimmed] == [2, 3, []] and list(out) == [] and trimmed == [0]


def test_ids_that_do_not_spell_the_text_are_an_error():
    import public_tokenizers as P
    import pytest
    c = bpe.Coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    c.put_together([["some", " words"]])
    c.chunk_codes.ids[" words"] = c.chunk_codes.ids["some"]
    with pytest.raises(ValueError):
        c.put_together([["some", " words"]])


def test_language_of_pages(spark):
    sf = "/root/testdata/sf0.001"
    pages, d = spark.read.parquet(f"{sf}/pages.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    got = collect(language.identify(spark, pages, d))
    assert np.mean([g["lang"] == g["declared"] for g in got]) > 0.95 and all(0 <= g["posterior"] <= 1.0000001 for g in got)
    odd = spark.createDataFrame([(1, None, None), (2, "nonsense", ""), (2, "nonsense", ""), (None, "http://a.b/fr/1", "<html lang=fr><p>le la</p>")], "page_id long, url string, html string")
    assert len(collect(language.identify(spark, odd, d))) == 4
    assert collect(language.identify(spark, pages.limit(0), d)) == []
    assert {g["lang"] for g in collect(language.identify(spark, odd, d.limit(0)))} == {None}
    assert language.address("https://u@www.a.example.org:80/de/x?y") == ("www.a.example.org", "example.org", "org/de")


def test_wrapped_and_double_spaced_notices():
    for notice in ["gnu general public license, version 2", "all rights reserved", "gnu affero general public license, version 2",
                   "creative commons attribution-sharealike 4.0", "permission is hereby granted, free of charge",
                   "gnu free documentation license 1.2", "open software license v3.0", "the mit license", "copyright (c) 2001, 2003",
                   "do what the fuck you want to public license", "eclipse public license 2.0", "in the public domain"]:
        plain = licenses.detect(f"so: {notice} .")
        assert plain
        for gap in ("\n", "  ", " \r\n\t "):
            text = f"so:{gap}{notice.replace(' ', gap)}{gap}."
            got = licenses.detect(text)
            assert [(d[0], d[3]) for d in got] == [(d[0], d[3]) for d in plain]
            assert [" ".join(text[d[1]:d[2]].split()) for d in got] == [f"so: {notice} ."[d[1]:d[2]] for d in plain]


def test_hostile_pages_and_values_are_read_once():
    import time
    pages = ["<" * 10**6, "<script>" * 125_000, "<!--" * 250_000, "<html " * 160_000, "<style " + "</style " * 120_000]
    texts = ["token" * 200_000, "token " * 160_000, "a=" * 500_000, "api-key" * 140_000, "auth_" * 200_000 + "-"]
    begin = time.process_time()
    assert [language.page_text(p) for p in pages[:1]] == [pages[0]] and all(language.declared(p) == "" for p in pages)
    for p in pages:
        language.page_text(p)
    for t in texts:
        assert secrets.spans(t) == []
    assert time.process_time() - begin < 10  # a megabyte each; quadratic patterns take minutes


def test_pages_without_their_marks():
    plain = {"a <!-- b > c --> d": "a   d", "<script>x<b</SCRIPT >y": " y", "<style>a{}</style\n>z<p>q": " z q", "1 < 2": "1 < 2", "<!-- open <b>x": " x",
             "<script>open <i>y</i>": " open  y ", "": "", "&lt;b&gt;": "<b>", None: ""}
    assert {p: language.page_text(p) for p in plain} == plain
    assert [language.declared(p) for p in ("<html><html x lang = 'FR'>", "<html lang=en-GB", "<htmllang=en>", None)] == ["fr", "en", "", ""]


def test_values_behind_credential_words():
    value = "zK9xQ2vLw8"
    for before in ("pwd: ", "my_auth_token=", "API-KEY = '", "api_key:", "Passphrase=\"", "credentials: "):
        assert [s[:3] for s in secrets.spans(before + value) if s[0] == "guess"] == [("guess", len(before), len(before) + len(value))]
    for before in ("password is ", "pass: ", "-key=", "token  =  ", "tokens-x: "):
        assert not [s for s in secrets.spans(before + value) if s[0] == "guess"]
    both = f"secret={value}&token={value}"
    assert [s[:3] for s in secrets.spans(both) if s[0] == "guess"] == [("guess", 7, len(both))]
