import random
import re

from lociq.llm import chat_format as cf
from lociq.llm import url_filter as uf


def brute_host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path, rules):
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fits)[3], max(fits)[4]) if fits else (None, "allow")


def test_urls_against_brute_force(spark):
    rng = random.Random(1)
    hosts = ["com", "EXAMPLE.com", "www.example.com", "a.www.example.com", "net", "x.net", "É.net", "notexample.com", "com.org", "", ".com", "a..net", "u:p@x.net:80"]
    urls = [None, "", "://", "no scheme", "http:/x.com/", "http://x.com", "http://x.com?y=://z.net/fr/", "a://b://c.net/es/"]
    urls += [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en', '/es/1', '/fr/?a', '/x/en/#/fr/'])}{rng.choice(['', '?q=/', '#h'])}" for _ in range(300)]
    urls += ["http://" + "a." * 300 + "net/es/" + "x/" * 5000, urls[9], urls[9]]
    more = [*uf.QUERY_RULES, ("block", "x.com", ""), ("allow", "net", "/es/1"), ("block", "net", "/es/1"), ("block", None, "/")]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for rules in (uf.QUERY_RULES, more, []):
        table = uf.rules_table(spark, rules) if rules else spark.createDataFrame([], "verdict string, host string, path string")
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge_urls(pages, table).collect()}
        known = [r for r in rules if r[1] is not None]
        assert got == {i: (*(hp := brute_host_path(u)), *(brute_rule(*hp, known) if u and "://" in u else (None, "allow"))) for i, u in enumerate(urls)}
    assert uf.judge_urls(pages.limit(0), uf.rules_table(spark, uf.QUERY_RULES)).collect() == []


def messages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, position string")


def test_quotes_link_to_originals(spark):
    rows = [
        (1, 0, "user", "How do I sort a list?\nAnd a dict?"),
        (1, 1, "assistant", "> How do I sort  a LIST?\n\nUse sorted()."),
        (1, 2, "user", "> > How do I sort a list?\n> Use sorted().\nThanks!\n"),
        (1, 3, "assistant", ">> How do I sort a list? and a dict?\r\n>nobody said this\nYes"),
        (1, 4, None, None),
        (2, 7, "user", "> Use sorted().\nother conversation"),
        (2, 9, "user", "a > b is no quote\n>  \n"),
    ]
    got = {(r.conv_id, r.turn): r for r in cf.link_quotations(messages(spark, rows)).collect()}
    assert len(got) == 7
    assert (got[1, 1].reply_to, got[1, 1].body, got[1, 1].quote_depth) == (0, "Use sorted().", 1)
    assert (got[1, 2].reply_to, got[1, 2].body, got[1, 2].quote_depth) == (1, "Thanks!", 2)
    assert [tuple(a) for a in got[1, 2].ancestors] == [(1, 1), (2, 0)]
    assert got[1, 3].reply_to is None and [tuple(a) for a in got[1, 3].ancestors] == [(2, 0)] and got[1, 3].body == "Yes"
    assert (got[1, 4].role, got[1, 4].body, got[1, 4].position) == ("user", "", 4)
    assert got[2, 7].reply_to is None and got[2, 7].position == 0 and got[2, 9].body == "a > b is no quote"


def test_latest_earlier_holder_over_buckets(spark):
    rows = [(1, t, "user", "same line") for t in range(0, 700, 50)] + [(1, 695, "user", "> same line\nre"), (1, 40, "user", "> same line"), (1, 0, "user", "> same line")]
    got = {(r.turn, r.body): r.reply_to for r in cf.link_quotations(messages(spark, rows)).collect()}
    assert got[695, "re"] == 650 and got[40, ""] == 0 and got[0, ""] is None


def test_nulls_ties_long_and_empty(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x"), (3, None, "user", "> x"), (3, 1, "b", "x"), (3, 1, "a", "y"), (3, 1, "a", "y"), (4, 0, "u", "> q\n" * 3000 + "z")]
    out = cf.render(cf.link_quotations(messages(spark, rows))).collect()
    assert len(out) == 7 and sorted(r.position for r in out if r.conv_id == 3) == [0, 1, 2, 3]
    assert [r.message for r in out if r.conv_id == 4] == ["<|u|>\nz\n<|end|>\n"]
    assert cf.link_quotations(messages(spark, rows).limit(0)).collect() == []


def brute_conversation(rows):
    """rows of one conversation, in order: (turn, text) -> [(position, reply_to)] by rows, from lists alone."""
    import re

    def parse(text):
        out = []
        for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
            m = re.match(r"((?:[ \t]{0,3}>)+) ?", line)
            level = m.group(1).count(">") if m else 0
            body = line[m.end() :] if m else line
            if out and out[-1][0] == level:
                out[-1][1].append(body)
            else:
                out.append((level, [body]))
        return out

    def units(runs, wanted):
        for level, lines in runs:
            if wanted(level):
                for u in [*lines, "\n".join(lines)] if len(lines) > 1 else lines:
                    if u := " ".join(u.lower().split()):
                        yield level, u

    parsed = [parse(t) for _, t in rows]
    held = [{u for _, u in units(p, lambda n: n == 0)} for p in parsed]
    parent, reply = [], []
    for i, (turn, _) in enumerate(rows):
        votes = {}
        for level, u in units(parsed[i], lambda n: n > 0):
            earlier = [(rows[j][0], j) for j in range(len(rows)) if turn is not None and rows[j][0] is not None and rows[j][0] < turn and u in held[j]]
            if earlier and level == 1:
                j = max(earlier)[1]
                votes[j] = votes.get(j, 0) + 1
        best = max(votes, key=lambda j: (votes[j], rows[j][0], j)) if votes else None
        reply.append(None if best is None else rows[best][0])
        parent.append(i - 1 if best is None else best)
    order = []

    def walk(i):
        order.append(i)
        for j in range(len(rows)):
            if parent[j] == i and j != 0:
                walk(j)

    if rows:
        walk(0)
    return [(order.index(i), reply[i]) for i in range(len(rows))]


def test_conversations_against_brute_force(spark):
    import random

    rng = random.Random(5)
    rows, want = [], []
    for conv in [None, *range(40)]:
        lines, own = [f"line {i} of {conv}" for i in range(4)] + ["common line"], []
        for turn in range(rng.randrange(1, 40)):
            t = rng.choice(lines) + rng.choice(["", "\n" + rng.choice(lines), " x"])
            for _ in range(rng.randrange(3)):
                t = rng.choice([">", "> > ", ">> "]) + rng.choice([*lines, "nowhere"]) + "\n" + t
            own.append((turn * 40 + conv % 3 if conv else turn * 300, t))
        rows += [(conv, turn, "u", t) for turn, t in own]
        want += [(conv, turn, *x) for (turn, _), x in zip(own, brute_conversation(own), strict=True)]
    got = [(r.conv_id, r.turn, r.position, r.reply_to) for r in cf.link_quotations(messages(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(p != sorted(t for c, t, *_ in want if c == conv).index(turn) for conv, turn, p, _ in want) > 20  # links do move messages


def test_rows_that_share_a_turn_and_null_conversations(spark):
    rows = [(1, 0, "user", "alpha line"), (1, 1, "user", "> alpha line"), (1, 1, "user", "no quote here")]
    got = {r.body: (r.reply_to, r.ancestors) for r in cf.link_quotations(messages(spark, rows)).collect()}
    assert got["no quote here"] == (None, None) and got[""][0] == 0
    texts = spark.createDataFrame([("", 0, "u", "gamma"), (None, 1, "u", "> gamma"), (None, 2, "u", "delta"), ("", 3, "u", "> delta"), ("c", 4, "u", "> gamma")], "conv_id string, turn long, role string, text string")
    assert {r.reply_to for r in cf.link_quotations(texts).collect()} == {None}


def test_one_turn_that_repeats_and_replies_of_replies(spark):
    rows = [(1, 0, "u", "same")] * 300 + [(1, None, "u", f"t{i}") for i in range(50)] + [(1, 5, "u", "> same\nback")] + [(2, i, "u", f"> m{i - 2}\nm{i}") for i in range(60)]
    got = cf.link_quotations(messages(spark, rows)).collect()
    assert sorted(r.position for r in got if r.conv_id == 1) == list(range(351)) and [r.reply_to for r in got if r.turn == 5 and r.conv_id == 1] == [0]
    chain = [(i, f"> m{i - 2}\nm{i}") for i in range(60)]
    assert sorted((r.turn, r.position, r.reply_to) for r in got if r.conv_id == 2) == [(t, *x) for (t, _), x in zip(chain, brute_conversation(chain), strict=True)]
