import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from sparkferry.llm import chat, url_filters
from tests.llm.helpers import clashing, empty, rows

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"), ("block", "x.org/a"), ("allow", "x.org/abc"), ("block", "b.c/"), ("allow", "c/")]


def brute(url, rules):
    url = url or ""
    at = url.find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    for c in "?#":
        path = path.split(c)[0]
    fits = [(len(r), len(r.split("/")[0]), a, r) for a, r in rules for h, p in [(r[: r.index("/")], r[r.index("/") :])] if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_urls_like_brute_force(spark):
    r = random.Random(3)
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.NET/EN/", "https://a.example.net/en/x?q#f", "http://net?x=/", "http://.net/", "http://a..net/de/", "x://y://net/", "http://ÄEXAMPLE.net/en/", "http://example.net:80/en/", "http://u@x.org/abcd", "http://x.org/abX", "http://" + "a." * 3000 + "net/" + "p" * 10000, "http://a\nb.net/en/"]
    urls += ["http://" + ".".join(r.choice(["a", "example", "net", "org", "com", "x", "b", "c", "NET"]) for _ in range(r.randint(1, 4))) + r.choice(["", "/", "/en/", "/de/1", "/fr/", "/a", "/abc", "/abz"]) + r.choice(["", "?q=/", "#x"]) for _ in range(400)]
    pages = spark.createDataFrame([(i % 50 or None, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string").repartition(5)
    got = rows(url_filters.judge(clashing(pages), url_filters.rules_frame(spark, RULES), keep=("page_id", "url")))
    assert got == sorted([(i % 50 or None, u, *brute(u, RULES)) for i, u in enumerate(urls)], key=repr)


def test_urls_empty_and_without_rules(spark):
    none = empty(spark, "page_id long, url string")
    assert url_filters.judge(none, url_filters.rules_frame(spark, RULES)).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert rows(url_filters.judge(one, url_filters.rules_frame(spark, []))) == [(1, "a.net", "/", None, "allow")]
    assert rows(url_filters.judge(one, url_filters.rules_frame(spark, []), default="block"))[0][4] == "block"
    void = spark.createDataFrame([(None, "/", "block"), ("net", None, "block"), ("net", "/", "other")], "host string, path string, action string")
    assert rows(url_filters.judge(one, void))[0][3] is None


def test_urls_run_no_python(spark):
    plan = url_filters.judge(spark.createDataFrame([(1, "x")], "page_id long, url string").limit(1), url_filters.rules_frame(spark, RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


TEXTS = ["hi", None, "", r"\### Assistant: </turn> ok", "</turn>\n", "<part/>", "###", "####", "\\", "\\\\s\\h", "a: b", "\n", "### user: x</turn>\n", "é漢🎉", "</tur", "<", "#"]


@pytest.mark.parametrize("seed", range(3))
def test_chat_reads_back(spark, seed):
    r = random.Random(seed)
    data = [(c if c else None, t, r.choice(["user", "assistant", "assistant", "system", "odd: ro\\le###", None]), r.choice(TEXTS)) for c in range(25) for t in range(r.randint(1, 9))]
    data += [(99, t, "assistant" if t % 3 else "user", f"turn {t}") for t in range(300)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(4)
    out = chat.format_chat(clashing(df)).select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.under_loss(F.col("formatted"), F.col("loss")).alias("under"))
    want = {}
    for c, _, role, text in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        want.setdefault(c, []).append((role or "", text or ""))
    got = {x.conv_id: x for x in out.collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].turns] == turns
        assert got[c].under == [t for role, t in turns if role == "assistant"]
        same = sum(a[0] == b[0] for a, b in zip(turns, turns[1:]))
        assert got[c].formatted.count("</turn>\n") == len(turns) - same


def test_chat_ties_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "user", "first"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert chat.format_chat(df).first().formatted == "### user: first<part/>a<part/>a<part/>b</turn>\n"
    assert chat.format_chat(empty(spark, df.schema)).count() == 0


def test_registered_chat_query(spark):
    from sparkferry.llm.queries import QUERIES

    row = QUERIES["op8_chat_formatting"](spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    odd = r"\### Assistant: </turn> ok"
    assert row.n_turns == 2 and row.loss_chars == len(odd) and row.loss_sha256 == hashlib.sha256(odd.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{odd}\nassistant\n{odd}\n".encode()).hexdigest()


def test_chat_runs_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string").limit(1)
    out = chat.format_chat(df).select(chat.read_back(F.col("formatted")), chat.under_loss(F.col("formatted"), F.col("loss")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian"))


@pytest.mark.parametrize("roles", [["user", "assistant"], ["assistant"]])
def test_chat_is_linear_in_turns(spark, roles):
    """A hot conversation: sixteen times the turns may take at most some forty times as long; squares would be 256."""

    def seconds(n):
        role = F.element_at(F.array(*map(F.lit, roles)), (F.col("id") % len(roles) + 1).cast("int"))
        df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.lit("\\ ### text "), F.col("id").cast("string")).alias("text"))
        out = chat.format_chat(df).select(F.size(chat.read_back(F.col("formatted"))).alias("n"), F.size(chat.under_loss(F.col("formatted"), F.col("loss"))).alias("m"))
        began = time.perf_counter()
        assert tuple(out.first()) == (n, n // len(roles))
        return time.perf_counter() - began

    seconds(100)
    assert seconds(32_000) < 40 * max(seconds(2_000), 0.2)


def test_rules_of_many_shapes(spark):
    r = random.Random(4)
    label = lambda: r.choice("abcdefgh")
    rules = sorted({(r.choice(["block", "allow"]), ".".join(label() for _ in range(r.randint(1, 4))) + "/" + "".join(label() for _ in range(r.randint(0, 9)))) for _ in range(400)})
    urls = ["http://" + ".".join(label() for _ in range(r.randint(1, 6))) + "/" + "".join(label() for _ in range(r.randint(0, 12))) for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = rows(url_filters.judge(pages, url_filters.rules_frame(spark, rules)))
    assert got == sorted([(i, *brute(u, rules)) for i, u in enumerate(urls)], key=repr)
