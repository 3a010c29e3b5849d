import fnmatch
import random
import re

from ledgerloom.llm import registry, url_filter


def regex(glob):
    out = "".join({"**": "(?s:.*)", "*": "[^/]*", "?": "(?s:.)"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|.", glob, re.S))
    return re.compile(out)


def test_automaton_equals_regular_expressions_over_many_words():
    r = random.Random(3)
    globs = ["".join(r.choices(["a", "b", "/", ".", "*", "**", "?", "é"], k=r.randint(1, 9))) for _ in range(60)]
    machine = url_filter.WildcardAutomaton(globs)
    assert machine.words > 1
    texts = ["".join(r.choices("ab/.é\U0001f642", k=r.randint(0, 12))) for _ in range(400)] + ["", "a" * 5000]
    order = list(range(len(globs)))
    want = [next((i for i in order if regex(globs[i]).fullmatch(t)), -1) for t in texts]
    assert machine.first_match(texts, order).tolist() == want
    assert fnmatch.fnmatch("a.b", "*.b")


def test_rules_hosts_and_defaults(spark):
    urls = [
        ("https://WWW.Example.com/en/1?x=/fr/", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://blog.example.com/en/", "blog.example.com", "/en/", "example.com/en/", "block"),
        ("http://example.com", "example.com", "", None, "allow"),
        ("http://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
        ("x://a.net/fr/", "a.net", "/fr/", "net/fr/", "block"),
        ("x://a.org/z.net/fr/", "a.org", "/z.net/fr/", None, "allow"),
        ("x://net/es/#y", "net", "/es/", "net/es/", "block"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("a://É.com?q", "É.com", "", None, "allow"),
        ("x://a.com/" + "p" * 20000, "a.com", "/" + "p" * 20000, "com/", "allow"),
    ]
    df = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.filter_urls(df, registry.URL_RULES).collect()}
    assert got == {i: u[1:] for i, u in enumerate(urls)}
    assert url_filter.filter_urls(df.limit(0), registry.URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, [], default="block").collect()} == {"block"}
