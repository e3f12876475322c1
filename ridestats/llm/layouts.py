"""Labelled pages: layouts as sites use them, with the content marked by class.

``keep`` marks an article, ``drop`` what stands inside it but is no part of it; both words
are taken out before features are computed. ``{n}`` in a layout is filled with words.
"""

from __future__ import annotations

import random

import numpy as np

from ridestats.llm.content import Page, featured, labels_by_mark
from ridestats.llm.dom import parse

# Outer layouts: {content} is one of the contents below.
_OUTER = (
    "<html><head><title>{3}</title></head><body><nav><ul><li><a href=/>{1}</a></li><li><a href=/>{1}</a></li><li><a>{1}</a></li></ul></nav>"
    "<div class=ad>{9}.</div><article class=keep>{content}</article><footer>{5}. {6}.</footer></body></html>",
    "<html><body><header><h1>{2}</h1><a href=/>{1}</a></header><div id=cookie-notice>{12}. <button>{1}</button></div><main class=keep>{content}</main>"
    "<aside class=sidebar><h3>{2}</h3><ul><li><a>{4}</a></li><li><a>{3}</a></li></ul><p>{14}.</p></aside><footer><p>{8}.</p></footer></body></html>",
    "<html><body><div class=menu><a>{1}</a> <a>{1}</a> <a>{2}</a></div><div class='keep post-content'>{content}</div><div class=comments>"
    "<h3>{1}</h3><div class=comment><p>{22}. {9}.</p></div><div class=comment><p>{12}.</p></div></div><div id=footer>{6}</div></body></html>",
    "<html><body><div id=header><div class=logo>{2}</div><form action=/s><label>{2}</label><input><button>{1}</button></form></div><div id=wrap>"
    "<div class=keep id=content>{content}</div><div id=sidebar><p>{16}.</p><a>{3}</a></div></div><div class=footer><p>{9}. {7}.</p></div></body></html>",
    "<html><body><div class=banner><p>{13}.</p></div><section><article class=keep>{content}</article><section id=comments><p>{18}. {6}.</p><p>{9}!</p>"
    "<form><p>{4}</p><textarea>{2}</textarea></form></section></section><footer>{4}</footer></body></html>",
    "<html><body><ul class=breadcrumbs><li><a>{1}</a></li><li>{2}</li></ul><div class='article-body keep'>{content}</div><div class=related><h4>{2}</h4>"
    "<p><a>{6}</a></p><p><a>{7}</a></p></div><div class=newsletter><form>{8} <input></form></div></body></html>",
    "<html><body><nav>{4}</nav><header><p>{8}.</p></header><article class=keep>{content}</article><aside><p>{20}. {5}.</p></aside>"
    "<section class=reader-comments><p>{25}.</p><p>{8}.</p></section><footer><p>{12}.</p></footer></body></html>",
)
_CONTENT = (
    "<h1>{6}</h1><p><b>{20}. {15}.<br><p>{30}. {22}, {9}.</p><p>{25}.</p>",
    "<h1>{4}</h1><p>{40}. <a>{2}</a> {14}.</p><p>{2}.</p><h2>{3}</h2><p>{45}, {12}.</p><ul><li>{9}.</li><li>{8} <em>{2}</em>.</li></ul>",
    "<header class=drop><div class='meta drop'>{4}</div></header><h2>{5}</h2><p>{33}.</p><blockquote><p>{14}.</p></blockquote><p>{50}. {20}.</p>",
    "<p>{60}. <strong>{3}</strong> {12}.</p><div class='ad drop'><p>{11}.</p></div><p>{24}. {18}.</p><div class='share drop'><a>{1}</a> <a>{1}</a></div>",
    "<div><p>{35}.</p><p>{7}.</p><table><tr><td>{2}</td><td>{3}</td></tr></table></div><div class='comments drop'><p>{20}.</p><p>{10}.</p></div>",
    "<h1>{3}</h1><div>{44}. {21}.</div><div>{4}.</div><form class=drop><label>{3}</label> <button>{1}</button></form><div>{30}.</div>",
    "<h1>{5}</h1><p>{1}.</p>",
    "<section><h2>{4}</h2><p>{28}. {9}</p></section><aside class=drop><p>{17}.</p></aside><nav class=drop><a>{2}</a> <a>{3}</a></nav><section><p>{38}.</p></section>",
)


def labelled_layouts(seed: int = 1) -> list[tuple[Page, np.ndarray]]:
    """Every content in every layout."""
    rnd = random.Random(seed)
    out = []
    for outer in _OUTER:
        for content in _CONTENT:
            html = outer.replace("{content}", content)
            while "{" in html:
                start, _, rest = html.partition("{")
                count, _, tail = rest.partition("}")
                html = start + " ".join("".join(rnd.choices("abcdefghiklmnoprstu", k=rnd.randrange(1, 9))) for _ in range(int(count))) + tail
            nodes = parse(html)
            label = labels_by_mark(nodes)
            for v in nodes:
                v.names = " ".join(w for w in v.names.split() if w not in ("keep", "drop"))
            out.append((featured(nodes), label))
    return out
