import base64
import hashlib
import html as entities
import random
import re

import pytest

from swingtrace.llm import archives, pagetext
from swingtrace.llm.common import shared_dir, table


def article_by_hand(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1).replace("<br>", " ")
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner))
    parts = [" ".join(entities.unescape(p).split()) for p in parts]
    return "\n\n".join(p for p in parts if p)


@pytest.fixture(scope="module")
def net(spark, sf):
    return pagetext.train(table(spark, sf, "pages").filter("page_id % 2 = 0"))


def test_held_out_pages(spark, sf, net):
    pages = [r.html for r in table(spark, sf, "pages").filter("page_id % 2 = 1").collect()]
    got = ["\n\n".join(b) for b in pagetext.texts(pages, net)]
    right = sum(g == article_by_hand(p) for g, p in zip(got, pages, strict=True))
    assert right >= 0.96 * len(pages)


def test_blocks_of_broken_markup():
    page = "<p>a &amp; b<p>c<br>d <b>e</b>f<script>x<p>y</script><!-- <p>z --><ul><li>1<li>2</ul>t &lt;p> 3 < 4 <img src='>'>u"
    assert [b[1] for b in pagetext.blocks(page)] == ["a & b", "c d ef", "1", "2", "t <p> 3 < 4 u"]


def test_page_odd_rows(spark):
    rows = [(1, "u", None, 1), (2, None, "", 2), (None, "u", "<p>", 3), (1, "u", "<!--", 4), (5, "u", "<div>" * 3000 + "x", 5)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = pagetext.extract(d).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert pagetext.extract(d.filter("false")).count() == 0


def test_network_gradients():
    import numpy as np

    from swingtrace.llm.recurrent import BiLstm

    r = np.random.default_rng(0)
    net = BiLstm(3, 2, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = r.normal(size=(4, 2, 3)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    y, w = r.integers(0, 2, (4, 2)).astype(float), mask.astype(float)

    def loss():
        p = 1 / (1 + np.exp(-net.logits(x, mask)))
        return float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum())

    g = net._gradients(x, mask, y, w)
    for name in ("wf", "wb", "bf", "out"):
        at = tuple(s // 2 for s in net.p[name].shape)
        net.p[name][at] += 1e-3
        up = loss()
        net.p[name][at] -= 2e-3
        assert g[name][at] == pytest.approx((up - loss()) / 2e-3, abs=1e-3)
        net.p[name][at] += 1e-3


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_archive_round_trip(spark):
    big = "".join(random.Random(1).choices("abcdefghij", k=17_000_000))
    rows = [(1, "u", big), (2, None, "x"), (2, "b", "x"), (None, "c", "x"), (3, "u\r\nz", None), (4, "d", ""), (5, "e", big), (6, "f", "ü\r\n\r\nWARC/1.1")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    path = shared_dir(spark, "warc")
    archives.write(d, path)
    got = archives.read(spark, path, payloads=True).collect()
    assert len(got) == len(rows)
    found = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got if r.page_id not in ("2", ""))
    text = {str(i): (h or "").encode() for i, _, h in rows}
    assert [(f[0], f[1], f[2]) for f in found] == [
        ("1", "response", None), ("3", "response", None), ("4", "revisit", "3"), ("5", "revisit", "1"), ("6", "response", None)
    ]
    assert all(f[3] == len(text[f[0]]) and f[4] == sha(text[f[0]]) for f in found)
    assert {r.page_id: bytes(r.payload) for r in got if r.record_type == "response"} == {k: text[k] for k in ("1", "2", "3", "6")}
    assert sorted(r.record_type for r in got if r.page_id == "2") == ["response", "revisit"]
    empty = shared_dir(spark, "warc")
    archives.write(d.filter("false"), empty)
    assert archives.read(spark, empty).count() == 0


def test_pages_query(spark, sf):
    pages = {r.page_id: (r.html or "").encode() for r in table(spark, sf, "pages").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    for r in archives.query(spark, sf).collect():
        raw = pages.pop(r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(raw), sha(raw))
        assert (r.record_type, r.refers_to) == (("response", None) if first[raw] == r.page_id else ("revisit", first[raw]))
    assert not pages


def test_reader_refuses_damage():
    good = archives.encode("1", "u", b"payload", archives.digest(b"payload"), None)
    assert [b for _, b in archives.Reader([good[:20], good[20:], good])] == [b"payload", b"payload"]
    with pytest.raises(ValueError, match="inside"):
        list(archives.Reader([good[:-9]]))
    with pytest.raises(ValueError, match="digest"):
        list(archives.Reader([archives.encode("1", "u", b"payload", archives.digest(b"other"), None)]))


def test_deep_pages_keep_their_open_elements():
    """A notice opened far above its text is still in the text's path, its end tag closes it, and unclosed elements cost little."""
    deep = "<div class=x>" * 150
    page = f"<html><body>{deep}<div class='notice'>{'<div>' * 120}inside{'</div>' * 120}</div>after{'</div>' * 150}</body></html>"
    (inside, a, _), (after, b, _) = pagetext.blocks(page)
    assert (a, b) == ("inside", "after")
    assert "notice" in inside and "notice" not in after and "x" in after
    many = pagetext.blocks("<body>" + "<div class=y>t</section></x>" * 50_000)
    assert len(many) == 50_000 and set(many[-1][0]) == {"html", "body", "div", "y"}
