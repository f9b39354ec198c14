import random
import re
from collections import Counter

import duckdb

import corpus_pipeline as P
from blockweave.llm import line_quality as Q
from blockweave.llm import registry
from tests.llm.helpers import SAMPLE, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_columns_same_as_brute_force(spark):
    rows = spark.read.parquet(f"{SAMPLE}/documents.parquet").select("doc_id", "text").collect()
    want = {r[0]: brute(r[1]) for r in rows}
    got = registry.op5_line_quality(spark, SAMPLE).collect()
    assert len(got) == len(rows)
    for r in got:
        n, _, _, _, repeat = want[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want[r["doc_id"]]
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def test_odd_texts(spark):
    texts = [None, "", " \n\n", "a b c a b c", "x\nx\n\x0bx", "é" * 5, "w " * 3000, (None, "n"), (5, "rep"), (5, "rep")]
    got = Q.judge(docs(spark, texts)).collect()
    assert len(got) == len(texts)
    by = {(r["doc_id"], r["n_words"]): r for r in got}
    assert by[(0, 0)]["base_failed"] and by[(3, 6)]["n_repeat_words"] == 6 and by[(4, 3)]["n_dup_lines"] == 1
    assert Q.judge(docs(spark, texts).limit(0)).count() == 0


def name(k):
    return "".join(chr(97 + int(c)) for c in str(k))


def own(k):
    return " ".join(f"word{name(k)}x{name(j)}" for j in range(60))


def test_boilerplate_is_found_across_documents(spark):
    footer = " ".join(f"terms {name(j)}" for j in range(400))
    texts = [f"{own(k)}\n{footer}" for k in range(30)] + [own(99), "\n".join(own(k) for k in range(200, 204)) + "\n" + footer]
    judged = Q.judge(docs(spark, texts))
    rows = {r["doc_id"]: r for r in judged.collect()}
    assert all(rows[k]["boilerplate_chars"] > 0 and not rows[k]["kept"] for k in range(30))
    assert rows[30]["kept"] and rows[30]["boilerplate_chars"] == 0
    assert [r["doc_id"] for r in Q.keep_good(docs(spark, texts)).orderBy("doc_id").collect()][0] == 30
    cleaned = Q.clean(docs(spark, texts), min_left=0.0).where("doc_id = 31").first()["text"]
    assert "terms" not in cleaned and own(203) in cleaned


def test_copies_are_left_alone(spark):
    texts = [own(1) + "\n" + own(2)] * 40 + [f"{own(1)}\n{own(2)}\n{own(3)} {k}" for k in range(40)]
    assert Q.keep_good(docs(spark, texts)).count() == 80


def test_hosts_are_apart(spark):
    a = docs(spark, [f"{own(k)}\nshared line here" for k in range(8)], source="a")
    b = docs(spark, [(100 + k, f"{own(50 + k)}\nshared line here") for k in range(8)], source="b")
    assert Q.judge(a.union(b)).where("boilerplate_chars > 0").count() == 0
    assert Q.judge(a.union(b), host_col="lang").where("boilerplate_chars > 0").count() == 16


def test_each_of_several_shared_lines_is_counted_in_all_documents(spark):
    shared = [" ".join(f"licence {name(m)} {name(j)}" for j in range(8)) for m in range(10)]
    texts = ["\n".join([*shared, own(k)]) for k in range(40)]
    want = sum(len(x.replace(" ", "")) for x in shared)
    assert {r["boilerplate_chars"] for r in Q.judge(docs(spark, texts)).collect()} == {want}


def test_a_large_host_has_no_higher_limit(spark):
    footer = " ".join(f"terms {name(j)}" for j in range(40))
    texts = [f"{own(k)}\n{footer}" for k in range(12)] + [f"text {name(k)} alone" for k in range(1500)]
    assert Q.judge(docs(spark, texts)).where("boilerplate_chars > 0").count() == 12
    kept = P.quality_rules(spark, docs(spark, texts), "").collect()
    assert sorted(r["text"] for r in kept) == sorted(own(k) for k in range(12))
    assert all(r["n_chars"] == len(r["text"]) for r in kept)


def columns(rows, names):
    return sorted(str(tuple(r[n] for n in names)) for r in rows)


def test_sample_same_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SAMPLE}/documents.parquet')")
    want = con.execute(registry.ORACLE_SQL["op5_line_quality"]).df()
    got = registry.op5_line_quality(spark, SAMPLE)
    assert columns(got.collect(), sorted(want.columns)) == columns(want.to_dict("records"), sorted(want.columns))


def test_verdict_over_several_hosts_same_as_brute_force(spark, tmp_path):
    """Documents of three hosts with shared lines in 3 to 40 of them, copies and depleted ones."""
    turn = random.Random(8)
    shared = [" ".join(f"notice {name(m)} {name(j)}" for j in range(turn.randrange(5, 60))) for m in range(12)]
    rows = []
    for k in range(240):
        host = turn.choice(["a", "b", None])
        lines = [own(k)[: turn.choice([40, 400])]] + [x for m, x in enumerate(shared) if turn.random() < (m + 1) / 40]
        turn.shuffle(lines)
        rows.append((k, "\n".join(lines), "en", host, 0))
    rows += [(1000 + k, *rows[turn.randrange(240)][1:]) for k in range(60)] + [(None, None, "en", "a", 0), (5, "", "en", "a", 0)]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs_.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    texts = {}
    for i, (_, text, _, host, _) in enumerate(rows):
        texts[i] = host, {Q.normal_line(x) for x in (text or "").split("\n") if x.strip()}, text or ""
    wholes = {}
    for host, lines, _ in texts.values():
        for x in lines:
            wholes.setdefault((host, x), set()).add(frozenset(lines))
    want = []
    for i, row in enumerate(rows):
        host, _, text = texts[i]
        n, chars, _, _, repeat = brute(text)
        gone = sum(len("".join(x.split())) for x in text.split("\n") if x.strip() and len(wholes[host, Q.normal_line(x)]) > 10)
        failed = n < 50 or 100 * repeat > 50 * n
        want.append((row[0], gone, not failed and chars - gone >= 0.2 * chars))
    judged = Q.judge(docs_).collect()
    assert columns(judged, ["doc_id", "boilerplate_chars", "kept"]) == sorted(map(str, want))
    assert {k for _, _, k in want} == {True, False} and sum(g > 0 for _, g, _ in want) > 50
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted((str(i), int(g), bool(k)) for i, g, k in con.execute(f"select doc_id, boilerplate_chars, kept from ({registry.ORACLE_SQL['op5_line_quality']})").fetchall()) == sorted((str(i), g, k) for i, g, k in want)
