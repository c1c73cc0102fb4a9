"""Piece codec, fill-in-the-middle and conversation repair against the library, SQL and brute force."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import conversation_repair as CR
from factloom.llm import fill_in_middle as FIM
from factloom.llm import piece_codec, queries
from tests.test_catalog import norm

SMALL = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, id string, ids string, n int, form string, output int"


def odd(spark):
    rows = [(1, None), (2, ""), (3, " "), (None, "no id\n"), (5, "x <P> y"), (6, "a\nb\n\nc"), (6, "a\nb\n\nc"), (7, "one two three. " * 60_000), (8, "y" * 200_000), (9, "\n" * 3000), (10, "▁ ▁▁ é 日本 😀 \x00 <s> </s> <0x41>")]
    return spark.createDataFrame([(*r, "id", "ids", 1, "form", 2) for r in rows], CLASH)


def matches_sql(spark, df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toArrow()) if not isinstance(t, str) else con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{t}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(tuple(norm(r[names.index(c)]) for c in sorted(names))) for r in cur.fetchall())
    assert sorted(repr(tuple(norm(r[c]) for c in sorted(names))) for r in df.collect()) == want


# -- 11 -------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(queries.PIECES))


@pytest.fixture(scope="module")
def codec():
    return piece_codec.Codec(queries.tokenizer_path(queries.PIECES))


def strings(n, seed=1):
    rng = random.Random(seed)
    some = ["ab ", "  ", "▁", " \n\t\r", "abcdefghijklmnopqrstuvwxyz ", "日本語漢字éü", "😀x\x00\x01‍", "ing tion the er in", "0123456789.,;:(){}=", "́ﬁＡＢ "]
    return ["".join(rng.choice(rng.choice(some)) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_codec_is_the_library(codec, library):
    texts = strings(4000) + ["x" * 5000, " " * 999, "ab" * 3000, "aaaa" * 999 + "b", "the" * 3000]
    got = codec.encode(texts)
    assert [g.tolist() for g in got] == [library.encode(t) for t in texts]
    assert [codec.decode(g) for g in got] == [library.decode(g.tolist()) for g in got]


def test_decode_of_any_ids_is_the_library(codec, library):
    rng = random.Random(2)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(32_000), 29_871]) for _ in range(rng.randint(0, 12))]
        assert codec.decode(np.array(ids, int)) == library.decode(ids)


def test_codec_by_slices_and_without_room(library, monkeypatch):
    monkeypatch.setattr(piece_codec, "GROUP", 7)
    small = piece_codec.Codec(queries.tokenizer_path(queries.PIECES), kept=3)
    texts = strings(300, 3) + ["m" * 50 + " word"]
    assert [g.tolist() for g in small.encode(texts)] == [library.encode(t) for t in texts]
    assert len(small.parts) <= 3 and len(small.pairs) <= 3


def test_codec_goes_back(codec):
    """Somewhere the longest match is not the right one, and is left again."""
    texts = " ".join(strings(500, 4)).replace(" ", "▁")
    greedy, at = [], 0
    while at < len(texts):
        p = next(texts[at : at + k] for k in range(16, 0, -1) if k == 1 or texts[at : at + k] in codec.made)
        greedy.append(p)
        at += len(p)
    assert greedy != codec.merge(texts[:2000])[: len(greedy)]


def test_codec_refuses_other_models(tmp_path):
    (tmp_path / "no.model").write_bytes(b"nothing")
    with pytest.raises(Exception):
        piece_codec.Codec(str(tmp_path / "no.model"))


def test_codec_query_and_odd_rows(spark, library):
    def want(t):
        ids = library.encode(t or "")
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op11_piece_codec(spark, SMALL).collect()
    assert len(got) == len(texts) and all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want(texts[r.doc_id]) for r in got)
    model = queries.tokenizer_path(queries.PIECES)
    o = odd(spark)
    back = piece_codec.decode(piece_codec.encode(o, model), model).collect()
    given = o.select("doc_id", "text").collect()
    assert sorted((r.id or 0, r.ids, r.decoded) for r in back) == sorted((r.doc_id or 0, library.encode(r.text or ""), library.decode(library.encode(r.text or ""))) for r in given)
    assert piece_codec.encode(spark.createDataFrame([], CLASH), model).count() == 0


# -- 12 -------------------------------------------------------------------------------------------------------------------


def test_rope_splits_as_lists_do():
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice("ab\né😀") for _ in range(rng.randint(0, 60)))
        lines, rope = re.findall(r"[^\n]*\n|[^\n]+", t), FIM.Rope.of(t, leaf=rng.randint(1, 9))
        assert rope.units() == len(lines) and str(rope) == t and rope.chars == len(t)
        k = rng.randint(0, len(lines))
        a, b = rope.split_units(k)
        assert (str(a), str(b)) == ("".join(lines[:k]), "".join(lines[k:])) and a.chars + b.chars == rope.chars and a.ends + b.ends == rope.ends


def test_fim_round_trip_and_sentinels():
    plan = FIM.Plan(rate=70)
    forms = set()
    for k, t in enumerate(strings(600, 6) + ["<", "<P", "P>\n<\n<S", ">M>\n", "a\n<P>"]):
        n, form, p, m, out = FIM.transform_text(k, t, plan)
        forms.add(form)
        assert FIM.restore_text(out, form, plan) == t and (p is None) == (form == "plain")
    assert forms == {"plain", "psm", "spm"}
    assert FIM.transform_text(1, "x <M>", FIM.Plan())[1] == "plain"
    for bad in ({"prefix": "<S>"}, {"prefix": "aba"}, {"prefix": ">x"}, {"middle": ""}):
        with pytest.raises(ValueError):
            FIM.Plan(**bad)
    with pytest.raises(ValueError):
        FIM.restore_text("<S>a<M>b", "psm", plan)


def test_fim_query_matches_sql(spark):
    matches_sql(spark, queries.op12_fill_in_middle(spark, "/root/testdata/sf0.01"), queries.OP12, documents="/root/testdata/sf0.01/documents.parquet")


def test_fim_odd_rows(spark, tmp_path):
    odd(spark).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op12_fill_in_middle(spark, str(tmp_path))
    matches_sql(spark, found, queries.OP12, documents=odd(spark).select("doc_id", "text"))
    assert FIM.restore(FIM.transform(spark.createDataFrame([], CLASH))).count() == 0


# -- 13 -------------------------------------------------------------------------------------------------------------------

CONVS = "conv_id long, turn long, role string, text string, part int, kind string, lines int, conv int"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = text.strip("\x20\t\n\x0b\x0c\r")
        out.append("b" if not solid else "d" if (role, text) in seen else "" if solid[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def brute(rows):
    """Every edit of every turn with up to two inserts at each place, told by the pattern of the roles that come out."""
    faults = faults_of(rows)
    ways = []
    for (role, text), f in zip(rows, faults):
        own = [(2, "D", None)]
        if f in ("", "t"):
            extra = 5 * (f == "t")
            own += [(extra, "K", (role, text))] + [(1 + extra, "R", (r, text)) for r in ("user", "assistant")]
        ways.append(own)
    inserts = [[(5 * n, "I" * n, c) for n in range(3) for c in itertools.product(("user", "assistant"), repeat=n)]] * (len(rows) + 1)
    best = None
    for own in itertools.product(*ways):
        base = sum(w[0] for w in own)
        if best and base > best[0]:
            continue
        for put in itertools.product(*inserts):
            cost = base + sum(p[0] for p in put)
            if best and cost > best[0] or cost > 10 + 7 * len(rows):
                continue
            audit, out = "", []
            for k, p in enumerate(put):
                audit, out = audit + p[1], out + [(r, "") for r in p[2]]
                if k < len(own):
                    audit, out = audit + own[k][1], out + ([own[k][2]] if own[k][2] else [])
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def test_repair_against_all_edits(spark):
    rng = random.Random(7)
    given = {}
    for c in range(60):
        given[c] = [(rng.choice(["user", "assistant", "system", "tool", "user", "assistant"]), rng.choice(["Well.", "So", "Yes!", "", "Oh?\n", f"n{rng.random()}."])) for _ in range(rng.randint(1, 4))]
    rows = [(c, k, r, t, 0, "k", 1, 2) for c, turns in given.items() for k, (r, t) in enumerate(turns)]
    found = CR.repair(spark.createDataFrame(rows, CONVS))
    turns = {}
    for r in sorted(found.turns.collect(), key=lambda r: (r.part, r.seq)):
        turns.setdefault(r.conv, []).extend(zip(r.roles, r.texts))
    got = {r.conv: r for r in found.conversations.collect()}
    assert got.keys() == given.keys()
    for c, rows in given.items():
        cost, audit, out = brute(rows)
        faults = faults_of(rows)
        assert (got[c].cost, got[c].audit, turns[c]) == (cost, audit, out), rows
        assert (got[c].blank, got[c].duplicate, got[c].truncated) == tuple(map(faults.count, "bdt"))


def test_long_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(CR, "BLOCK", 8)
    monkeypatch.setattr(CR, "FAN", 3)
    rng = random.Random(8)
    turns = [(rng.choice(["user", "assistant", "system"]), rng.choice([f"t{rng.randrange(600)}.", "a text that is repeated often.", "cut", " "])) for _ in range(1500)]
    m = CR.block_matrix([r[0] for r, _ in turns], [CR.BLANK if f == "b" else CR.DUPLICATE if f == "d" else CR.CUT if f == "t" else CR.NONE for f in faults_of(turns)])
    cost, audit = CR.best(m)
    rows = [(5, k, r, t, 0, "k", 1, 2) for k, (r, t) in enumerate(turns)] + [(c, 0, "user", "Hi.", 0, "k", 1, 2) for c in range(200) if c != 5]
    found = CR.repair(spark.createDataFrame(rows, CONVS).repartition(6))
    got = found.conversations.where("conv = 5").collect()
    parts = {r.part for r in found.turns.where("conv = 5").collect()}
    assert len(parts) > 2 and [(r.cost, r.audit) for r in got] == [(cost, audit)]
    faults = faults_of(turns)
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(turns, turns[1:])]
    assert (got[0].blank, got[0].duplicate, got[0].truncated) == tuple(map(faults.count, "bdt"))
    assert got[0].illegal == sum(p not in ("su", "ua", "au") for p in pairs) and got[0].gaps == 0
    said, _ = CR.apply_edits(audit, [r for r, _ in turns], [t for _, t in turns], 0, (len(audit) - audit.count("D")) % 2 == 1)
    assert re.fullmatch("s?(ua)+", "".join(r[0] for r in said))
    digest = CR.digest_rows(found, spark.createDataFrame([(5,)], "conv long")).where("conv = 5").first()
    roles, texts = CR.apply_edits(audit, [r for r, _ in turns], [t for _, t in turns], 0, (len(audit) - audit.count("D")) % 2 == 1)
    assert digest.repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in zip(roles, texts)).encode()).hexdigest()


def test_repair_query_matches_sql(spark):
    matches_sql(spark, queries.op13_conversation_repair(spark, "/root/testdata/sf0.01"), queries.OP13, conversations="/root/testdata/sf0.01/conversations.parquet")


def test_repair_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None)] * 40 + [(None, 3, "user", "Hm.")] * 30 + [(1, None, "user", "Yes."), (1, None, "assistant", "No."), (2, 5, "", "x."), (2, 9, "user", ""), (3, 1, "sys", "S."), (3, 2, "u", "U."), (3, 2, "a", "A. " * 50_000)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"{t}.") for c in range(100, 160) for t in range(0, 8, 1 + c % 2)]
    t = spark.createDataFrame([(*r, 0, "k", 1, 2) for r in rows], CONVS)
    t.write.parquet(str(tmp_path / "conversations.parquet"))
    matches_sql(spark, queries.op13_conversation_repair(spark, str(tmp_path)), queries.OP13, conversations=t.select("conv_id", "turn", "role", "text"))
    none = CR.repair(spark.createDataFrame([], CONVS))
    assert none.conversations.count() == 0 and none.turns.count() == 0


def test_conversation_whose_rows_all_go(spark):
    convs = spark.range(3).select(F.col("id").alias("conv"))
    got = CR.digest_rows(CR.repair(spark.createDataFrame([], CONVS)), convs).collect()
    assert [(r.cost, r.audit, r.repaired_sha256) for r in got] == [(0, "", hashlib.sha256(b"").hexdigest())] * 3
