"""Secrets, personal data and page text: against plain patterns on fixtures and on odd rows."""

import base64
import hashlib
import random
import re
import time
import zlib

import pytest

from lapwing.llm import main_text, pii, secret_scan


def span_lists(texts, maker):
    return {key: maker(text or "") for key, text in texts}


def test_base_secrets_like_plain_patterns():
    rng = random.Random(4)
    parts = ["token", "=", " ", '"', "Secret:", "pass", "wd", "password", "api_key", "apikey", "AKIA", "ABCDEF0123456789", "deadbeef",
             "0123456789abcdef", "ſecret", "é", "😀", "\n", "x", "TOKEN", ":", "abc123"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        got = [s for s in secret_scan.scan(text) if s[2] in secret_scan.KINDS[:3]]
        assert got == secret_scan.brute_base(text), text


def test_checked_secrets():
    body = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123"
    value, check = zlib.crc32(body), ""
    for _ in range(6):
        value, rest = divmod(value, 62)
        check = secret_scan.BASE62[rest] + check
    good = f"x ghp_{body.decode()}{check} y"
    assert (2, 42, "checked") in secret_scan.scan(good)
    assert not secret_scan.scan(good.replace("ABC", "ABD"))
    signed = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.c2ln"
    assert secret_scan.scan(signed) == [(0, len(signed), "signed")]
    assert not secret_scan.scan("eyJhbGci.eyJzdWIi.c2ln")


def test_secrets_of_long_and_odd_texts():
    """A megabyte of beginnings takes linear time, and no claim is too deep to be refused."""
    head = "eyJhbGciOiJIUzI1NiJ9"
    whole = f"{head}.eyJzdWIiOiIxIn0.c2ln"
    deep = base64.urlsafe_b64encode(b'{"a":' * 60_000).decode().rstrip("=")
    assert secret_scan.scan(f"{head}.{deep}.c2ln") == []
    begin = time.monotonic()
    for text in ("eyJ" * 350_000, "eyJa." * 200_000, "eyJa.eyJb" * 110_000, "token " * 170_000, "AKIA" * 250_000, "-----BEGIN " * 90_000):
        found = [s for s in secret_scan.scan(text + " " + whole) if s[2] == "signed"]
        assert found == [(len(text) + 1, len(text) + 1 + len(whole), "signed")]
    assert time.monotonic() - begin < 60
    # A place later in a run that failed is not tried, one in the next run is.
    assert [s[:2] for s in secret_scan.scan(f"eyJeyJ_x {whole}eyJ.eyJ")] == [(9, 9 + len(whole) + 3)]


def test_secrets_of_documents(spark, docs, texts, nothing):
    rows = spark.createDataFrame(
        [(1, "token = abcdef12"), (1, "token = abcdef12"), (None, "AKIA" + "B" * 16), (3, None), (4, "é " + "a1" * 12)],
        "doc_id long, text string",
    )
    got = sorted(tuple(r) for r in secret_scan.digest(secret_scan.scan_documents(rows)).fillna(-1, ["doc_id"]).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == [
        (-1, 0, 1, 0, sha("access:0:20"), "access:0:20"),
        (1, 1, 0, 0, sha("assign:0:16"), "assign:0:16"),
        (1, 1, 0, 0, sha("assign:0:16"), "assign:0:16"),
        (3, 0, 0, 0, sha(""), ""),
        (4, 0, 0, 1, sha("hex:2:26"), "hex:2:26"),
    ]
    assert secret_scan.digest(secret_scan.scan_documents(nothing)).count() == 0
    assert secret_scan.scan_documents(docs).count() == len(texts)


def plain_pii(text):
    """The base spans, by the plain patterns and Python's own arithmetic."""

    def luhn(digits):
        total = 0
        for i, d in enumerate(reversed(digits)):
            d = int(d) * (1 + i % 2)
            total += d - 9 * (d > 9)
        return total % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    return [
        f"{kind}:{m.start()}:{m.end()}"
        for kind, (pattern, good) in tests.items()
        for m in re.finditer(pattern, text)
        if good(m[0])
    ]


def test_pii_like_plain_patterns(spark):
    rng = random.Random(9)
    parts = ["a@b.com", "_x@y.org", "me.you@", "@", ".", "host-1.net", "192.168.0.1", "256.1.1.1", "1.2.3.4.5", "0010.2.3.4",
             "4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "12", " ", "-", "é", "😀",
             "\n", "+49 30 1234567", "x", "5", "GB82 WEST 1234 5698 7654 32"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += ["7" * 20_000, "a" * 20_000 + "@", "1 " * 5000, "a.b@c.de " * 300, None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    base = [kind.name for kind in pii.KINDS[: pii.BASE]]
    for row in pii.pii_digest(frame).collect():
        want = plain_pii(texts[row["doc_id"]] or "")
        got = [s for s in row["spans"].split(",") if s.split(":")[0] in base]
        assert got == want, texts[row["doc_id"]]
        assert row["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in base] == [sum(w.startswith(k) for w in want) for k in base]


def _many(n):
    """A text of n matches of several kinds, characters outside the basic plane between them."""
    piece = "call \U0001f4de a{0}@example{0}.org from 10.0.{1}.7, card 4111 1111 1111 1111 or GB82 WEST 1234 5698 7654 32 é\n"
    return "".join(piece.format(i, i % 300) for i in range(n))


@pytest.mark.parametrize("matches", [pii.RUN - 1, pii.RUN, 2 * pii.RUN, 300])
def test_pii_of_many_matches_like_plain_patterns(spark, matches):
    text = _many(matches)
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.pii_digest(frame).first()
    want = plain_pii(text)
    base = [kind.name for kind in pii.KINDS[: pii.BASE]]
    spans = [s.split(":") for s in row["spans"].split(",")]
    assert [":".join(s) for s in spans if s[0] in base] == want
    for kind, a, b in spans:
        if kind == "iban":
            assert text[int(a) : int(b)] == "GB82 WEST 1234 5698 7654 32"
    assert sum(kind == "iban" for kind, _, _ in spans) == matches
    # The words near a span are read where the span is: an address stands after "call", a card after its name.
    scores = dict(zip(map(tuple, spans), row["scores"].split(","), strict=True))
    assert {v for k, v in scores.items() if k[0] == "card"} == {"0.90"}


def test_pii_time_grows_with_the_matches(spark):
    """A text of 40 000 addresses takes seconds."""
    text = " ".join(f"a{i}@b.cd" for i in range(40_000))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.pii_digest(frame.limit(0)).count()
    begin = time.time()
    assert pii.pii_digest(frame).first()["n_email"] == 40_000
    assert time.time() - begin < 20


def test_pii_adds_accounts_and_scores(spark, nothing):
    rows = spark.createDataFrame([(1, "IBAN GB82 WEST 1234 5698 7654 32."), (2, "GB83 WEST 1234 5698 7654 32")], "doc_id long, text string")
    one, two = sorted(tuple(r)[-2:] for r in pii.pii_digest(rows).collect())[::-1]
    assert one == ("iban:5:32", "1.00") and two == ("", "")
    assert pii.pii_digest(nothing).count() == 0


def test_pii_accounts_end_where_the_checksum_says(spark):
    spain, austria, britain = "ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "GB82 WEST 1234 5698 7654 32"
    joined = [number.replace(" ", "") for number in (spain, austria, britain)]
    cases = [
        (f"é {number}{after}", [(2, 2 + len(number))])
        for number in (spain, austria, britain, *joined)
        for after in ("", ".", " El banco", " Bank", " BANK", " BANK OF X", " A", " 12", " 2024 12", " x", ", x", "\n", "😀")
    ]
    cases += [(f"{number}{after}", []) for number in (spain, *joined) for after in ("x", "9z", "A")]
    # Heads that are no number hide none, and a number may follow another at once.
    cases += [(f"AB12 3456 7890 {austria}", [(15, 39)]), (f"{austria} {spain} Q", [(0, 24), (25, 54)]), (f"X{austria}", [])]
    cases += [("ES92" + spain[4:] + " El", []), ("AB12 3456 " * 300, []), ("AB12" * 5000, [])]
    frame = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "doc_id long, text string").repartition(4)
    for row in pii.find_pii(frame).collect():
        text, want = cases[row["id"]]
        assert [(s["start"], s["end"]) for s in row["found"] if s["kind"] == "iban"] == want, text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("just words &amp; more", "just words & more"),
        ("<p>a  b<br>c</p><p> </p><p>d", "a b c\nd"),
        ("<nav>menu</nav><main><h1>T</h1><p>one<p class=ad>buy<p>two</main><footer>f</footer>", "T\none\ntwo"),
        ("<article><header><h1>T</h1></header>text<section class='comments'>mine</section></article>", "T\ntext"),
        ("<script>var t='</p>';</script><style>p{}</style><p>x</p>", "x"),
        ("<body><div id='cookie-notice'>ok?</div><p>Real words here.</p><form>f<input></form>", "Real words here."),
        ("<p>caf&eacute; &#x1F600; &nbsp; end</p>", "café 😀 end"),
        ("<article><p>unclosed <b>bold<p>next</article>", "unclosed bold\nnext"),
        ("<<>> & <", "<<>> & <"),
    ],
)
def test_main_text(html, text):
    assert main_text.main_text(html) == text


PROSE = "The river ran past the old stone house, and nobody in the village could say who had built it."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<div class='{name}'><nav>menu</nav><article><h1>T</h1><p>{PROSE}</p></article></div>", f"T\n{PROSE}")
        for name in ("site has-sidebar", "content-sidebar-wrap", "sidebar", "widget", "header")
    ]
    + [
        (f"<form><div id=page><main><p>{PROSE}</p></main></div><input></form>", PROSE),
        # Without an article: the same wrappers, and named elements that hold little.
        (f"<div class='site has-sidebar'><p>{PROSE}</p><div class=sidebar>links</div></div>", PROSE),
        (f"<div class='sidebar'><p>{PROSE}</p><p>{PROSE}</p></div><p>{PROSE}</p>", "\n".join([PROSE] * 3)),
        (f"<form><p>{PROSE}</p></form><div class=site-footer>f</div>", PROSE),
        # Inside an article: whole names only; other articles and what they hold don't come back.
        (f"<article><p class=has-share>{PROSE}</p><p>{PROSE}</p><div class=share>s</div></article>", f"{PROSE}\n{PROSE}"),
        (f"<article><p>{PROSE}</p></article><div class=related-posts><article><p>more</p></article></div>", PROSE),
        (f"<article><p>{PROSE}</p><div class=comments><p>{PROSE}</p><p>{PROSE}</p></div></article>", PROSE),
    ],
)
def test_names_of_wrappers(html, text):
    assert main_text.main_text(html) == text


LINKS = "".join(f"<li><a href=x>l{i}</a></li>" for i in range(9))
LONG = " ".join([PROSE] * 3)
LONG_LINES = "\n".join([LONG] * 5)
LONG_HTML = f"<p>{LONG}</p>" * 5


@pytest.mark.parametrize(
    ("html", "text"),
    [
        # The ratio drops regions inside an article, and keeps them outside of it where they are as dense.
        (f"<article><div><ul>{LINKS}</ul></div><hr><div>a</div><div>b</div><div>c</div><div>{LONG_HTML}</div></article>", None),
        (f"<article>{LONG_HTML}</article><div>{LONG_HTML}</div>", f"{LONG_LINES}\n{LONG_LINES}"),
        (f"<article>{LONG_HTML}</article><div><ul>{LINKS}</ul></div>", LONG_LINES),
        (f"<div>{LONG_HTML}</div><div><div>Posted in news</div></div><ul>{LINKS}</ul>", None),
    ],
)
def test_ratio_selects_regions(html, text):
    got = main_text.main_text(html)
    assert got == text if text is not None else (LONG_LINES in got and "l0\n" not in got and "l8" not in got)


def page_of(rng, names):
    """A page with its article's blocks, and what stands around it."""
    sentence = lambda: " ".join(rng.choice(names) for _ in range(rng.randint(25, 60))) + "."
    blocks, html = [], []
    for _ in range(rng.randint(3, 8)):
        kind = rng.choice(["p", "p", "p", "list", "table", "quote"])
        if kind == "list":
            items = [f"{rng.choice(names)} {i}" for i in range(rng.randint(2, 6))]
            blocks += items
            html.append("<ul>" + "".join(f"<li>{item}" for item in items) + "</ul>")
        elif kind == "table":
            cells = [[f"{rng.choice(names)} {i}", str(i * 7)] for i in range(10)]
            blocks += [cell for row in cells for cell in row]
            html.append("<table><tbody>" + "".join(f"<tr><th>{a}</th><td>{b}</td></tr>" for a, b in cells) + "</tbody></table>")
        else:
            blocks.append(text := sentence())
            html.append(f"<p>{text}</p>" if kind == "p" else f"<blockquote><p>{text}</p></blockquote>")
    links = "".join(f"<li><a href=/{n}>{n}</a></li>" for n in names[:6])
    comment = f"<div class='{rng.choice(['comments', 'user-comment', 'reader-comments', 'comment-thread'])}'><p>{sentence()}</p></div>"
    around = [
        f"<nav><ul>{links}</ul></nav>", f"<div class='sidebar'><p>{sentence()}</p></div>", comment,
        f"<form><label>{sentence()}</label><input></form>", "<script>var a = '<p>x</p>';</script>", f"<footer>{sentence()}</footer>",
        f"<div class='cookie-notice'>{sentence()}</div>", f"<div class='ad-banner'>{sentence()}</div>",
    ]
    rng.shuffle(around)
    cut = rng.randint(0, len(around))
    return f"<html><head><title>t</title></head><body>{''.join(around[:cut])}<article>{''.join(html)}</article>{''.join(around[cut:])}</body></html>", blocks


def test_labelled_pages():
    """Pages whose article is known block by block: nothing of it goes, nothing else stays."""
    rng = random.Random(21)
    names = "river stone glass cloud ocean paper light tree lamp window".split()
    for _ in range(150):
        html, blocks = page_of(rng, names)
        assert main_text.main_text(html) == "\n".join(blocks)


def test_deep_markup_takes_linear_time():
    begin = time.monotonic()
    for part in ("<div>", "<div class=ad>", "<article>", "<article><p>a<b>c", "<table><tr><td>", "<div hidden>"):
        main_text.main_text(part * 60_000 + "x" + "</section></td></i>" * 200)
    assert time.monotonic() - begin < 60


def test_pages(spark):
    rows = [(1, "u", "<p>x</p>", "t"), (1, "u", "<p>x</p>", "t"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = main_text.extract_pages(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["text"], r["n_chars"]) for r in got.collect()) == [("", 0), ("x", 1), ("x", 1)]
    assert main_text.extract_pages(pages.limit(0)).count() == 0
