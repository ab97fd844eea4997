r"""Main text of web pages by equivalence-class template deduction.

Pages of one host are compared in groups of about ``GROUP`` (a large host is cut into many groups by a hash of the page), so no
host, however large, lands in one task. Hosts of few pages travel together, but are never compared with one another. In a group:

1. Every page becomes tokens: tags (with class and id) and words. Comments, scripts, styles and the like are skipped whole.
2. Tokens with the same occurrence vector (counts over the group's pages) form a class.
3. A class of tags is valid as skeleton if its tokens occur at most once a page, on at least half of the pages, and in one order
   on all of them. Valid classes nest: together they must still have one order on all pages, which makes the template.
4. A slot is a place in the template, named by the skeleton elements open around it (where most pages have them, so that an end
   tag missing on one page does no harm). Text inside elements for menus, headers, footers, sidebars, notices, adverts, forms
   and comments is template matter, unless such an element is known by its class, id or role alone and holds most of a page's
   text; of the other slots, those inside the innermost skeleton element that holds most of the
   text over the group are the main ones. Their text is extracted from each page, wherever the main element stands on it.
5. A page on which this gives no text, or whose host has fewer than ``LEAST`` pages, takes the tags that it has once itself as
   its skeleton.

Blocks end at block tags; ``<br>`` counts as white space. References are decoded, white space in a block becomes one space, and
blocks are joined by \n. A missing end (cut pages) ends the slot with the page. Null and empty pages give an empty text; a null
url is a host of its own; repeated pages are extracted each. Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm.common import pick, table, written

#: Pages in a group, and the least that a host needs for groups of its own.
GROUP, LEAST = 48, 8
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|iframe|select)(?=[\s/>]|\Z)(?!(?:[^<>"']|"[^"]*"|'[^']*')*(?<=[\s"'])/>|/>)(?:[^>"']|"[^"]*"|'[^']*')*(?:>.*?(?:</\1\s*>|\Z)|\Z)|<[A-Za-z/!?][^<>"']*(?:"[^"]*"[^<>"']*|'[^']*'[^<>"']*)*>?|[^<]+|<""", re.S | re.I)
TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9-]*)")
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that never hold main text, by name and by a whole class, id or role. The latter say nothing of WHOLE elements, nor
#: of one that holds most of a page's text.
ASIDE = frozenset("head title nav header footer aside form button menu dialog input label legend fieldset".split())
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disclaimer footer header menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
CENTRE = frozenset("article main".split())
WHOLE = CENTRE | {"html", "body"}
#: Blocks of one paragraph or line, too small to be a page's main element.
LEAF = frozenset("address blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary".split())

Token = tuple[str, str, str, bool]


def tokens(page: str) -> list[Token]:
    """(kind, name, key, aside): kind is open, close or text; the key of a tag has its class and id."""
    out: list[Token] = []
    for m in TOKEN.finditer(page):
        raw = m[0]
        if raw[0] != "<" or len(raw) == 1:
            out.append(("text", "", raw, False))
        elif not m[1] and (t := TAG.match(raw)):
            name = t[1].lower()
            if raw[1] == "/":
                out.append(("close", name, f"</{name}>", False))
                continue
            marks = [next(filter(None, x[1:]), "") for x in NAMED.findall(raw)]
            words = {w for x in marks for w in x.lower().split()} if name not in WHOLE else set()
            out.append(("open", name, f"<{name} {' '.join(marks)}>".replace(" >", ">"), name in ASIDE or bool(words & ASIDE_WORDS)))
            if raw.endswith("/>") and name not in VOID:
                out.append(("close", name, f"</{name}>", False))
    return out


def classes(pages: list[list[Token]]) -> list[list[str]]:
    """Token keys with equal occurrence vectors; words count with the tags."""
    vectors: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for i, page in enumerate(pages):
        own = Counter(chain.from_iterable(key.split() if kind == "text" else (key,) for kind, _, key, _ in page))
        for part, n in own.items():
            vectors[part].append((i, n))
    by_vector: dict[tuple, list[str]] = defaultdict(list)
    for key, vector in vectors.items():
        by_vector[tuple(vector)].append(key)
    return list(by_vector.values())


def skeleton(pages: list[list[Token]]) -> list[str]:
    """Tags of the valid classes in template order."""
    tags = {t[2] for page in pages for t in page if t[0] != "text"}
    where = [{} for _ in pages]
    for at, page in zip(where, pages, strict=True):
        for i, t in enumerate(page):
            if t[0] != "text":
                at[t[2]] = i if t[2] not in at else -1
    chosen: list[tuple[str, ...]] = []
    for own in classes(pages):
        keys = [k for k in own if k in tags]
        found = [[at[k] for k in keys] for at in where if keys and keys[0] in at]
        if not keys or 2 * len(found) < len(pages) or any(-1 in f for f in found):
            continue
        order = sorted(range(len(keys)), key=lambda j: found[0][j])
        if all(all(f[a] < f[b] for a, b in zip(order, order[1:])) for f in found):
            chosen.append((len(found), tuple(keys[j] for j in order)))
    template: list[str] = []
    for _, keys in sorted(chosen, key=lambda c: (-c[0], -len(c[1]), c[1])):
        trial = nested(template, keys, where)
        if trial:
            template = trial
    return template


def nested(template: list[str], keys: tuple[str, ...], where: list[dict[str, int]]) -> list[str] | None:
    """The template with the class put into its slots, if all pages agree on one order."""
    if not template:
        return list(keys)
    order = list(template)
    for key in keys:
        slot = None
        for at in where:
            if key not in at:
                continue
            before = [k for k in order if k in at and at[k] < at[key]]
            after = [k for k in order if k in at and at[k] > at[key]]
            low = order.index(before[-1]) + 1 if before else 0
            high = order.index(after[0]) if after else len(order)
            slot = (low, high) if slot is None else (max(slot[0], low), min(slot[1], high))
            if low > high or slot[0] > slot[1] or any(order.index(k) >= order.index(after[0]) for k in before if after):
                return None
        order.insert(slot[0], key)
    return order


State = tuple[tuple[str, ...], bool]


def walk(page: list[Token], template: set[str], around: dict[str, tuple[str, ...]] | None = None) -> list[State]:
    """For each token: the skeleton elements open around it (its slot), and whether any open element is template matter.

    ``around`` gives the slot in which each skeleton element stands on most pages; elements left open before one are closed.
    """
    stack: list[tuple[str, str, bool, State]] = []  # each element with the state around it
    out: list[State] = []
    state: State = ((), False)
    for kind, name, key, aside in page:
        if kind == "open":
            if around and key in around:
                for i, (_, own, _, before) in enumerate(stack):
                    if own in template and own not in around[key]:
                        state = before
                        del stack[i:]
                        break
            if name in BLOCK:  # ends an open paragraph of the same block
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        state = stack[i][3]
                        del stack[i:]
                    elif stack[i][0] in BLOCK:
                        break
        out.append(state)
        if kind == "open" and name not in VOID:
            stack.append((name, key, aside, state))
            if key in template or aside and not state[1]:
                state = ((*state[0], key) if key in template else state[0], aside or state[1])
        elif kind == "close":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    state = stack[i][3]
                    del stack[i:]
                    break
    return out


def main_element(pages: list[list[Token]], template: set[str]) -> tuple[str | None, list[list[State]]]:
    """The key of the innermost skeleton element that holds most text, and the pages walked with the places of skeleton elements."""
    places: dict[str, Counter] = defaultdict(Counter)
    for page in pages:
        for t, (slot, _) in zip(page, walk(page, template), strict=True):
            if t[0] == "open" and t[2] in template:
                places[t[2]][slot] += 1
    around = {k: min(c, key=lambda p: (-c[p], len(p), p)) for k, c in places.items()}
    weight: Counter = Counter()
    names = {}
    walked = [walk(page, template, around) for page in pages]
    for page, states in zip(pages, walked, strict=True):
        for t, (slot, aside) in zip(page, states, strict=True):
            names[t[2]] = t[1]
            if t[0] == "text" and not aside:
                weight[slot] += len(t[2].strip())
    total, best = sum(weight.values()), None
    inside: Counter = Counter()
    for q, w in weight.items():
        for k in set(q):
            inside[k] += w
    for p in sorted({q[: i + 1] for q in weight for i in range(len(q))}, key=lambda p: (len(p), p)):
        key = p[-1]
        centre, name = best is not None and names[best] in CENTRE, names[key]
        if name in CENTRE and inside[key] and not centre or name in BLOCK and name not in LEAF and 2 * inside[key] > total and (not centre or name in CENTRE):
            best = key
    return best, walked


def text_of(page: list[Token], states: list[State], best: str | None) -> str:
    """The text inside the element ``best``, wherever it stands on the page; None is the whole page."""
    blocks, part = [], []
    for (kind, name, key, _), (slot, aside) in zip(page, states, strict=True):
        if kind == "text":
            if not aside and (best is None or best in slot):
                part.append(key)
        elif name == "br":
            part.append(" ")
        elif name in BLOCK:
            blocks.append("".join(part))
            part = []
    blocks.append("".join(part))
    clean = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def spared(pages: list[list[Token]]) -> list[list[Token]]:
    """The pages; a marked element that holds most of its page's text is no template matter.

    Text that stands on most pages of the host counts for nothing here.
    """
    own = [{t[2] for t in page if t[0] == "text"} for page in pages]
    common = {k for k, n in Counter(k for texts in own for k in texts).items() if 2 * n > len(pages)} if len(pages) >= LEAST else set()
    out = []
    for page in pages:
        marked = {i for i, t in enumerate(page) if t[3] and t[1] not in ASIDE}
        if marked:
            plain = [(t[0], t[1], str(i), False) if i in marked else t for i, t in enumerate(page)]
            total, inside = 0, Counter()
            for t, (slot, aside) in zip(plain, walk(plain, {str(i) for i in marked}), strict=True):
                if t[0] == "text" and not aside and t[2] not in common and (n := len(t[2].strip())):
                    total += n
                    for i in slot:
                        inside[i] += n
            page = [t[:3] + (False,) if i in marked and 2 * inside[str(i)] > total else t for i, t in enumerate(page)]
        out.append(page)
    return out


def extract_group(pages: list[str]) -> list[str]:
    """The main texts of pages of one host."""
    parsed = spared([tokens(p) for p in pages])
    template = set(skeleton(parsed)) if len(pages) >= LEAST else set()
    best, walked = main_element(parsed, template) if template else (None, [[] for _ in parsed])
    out = []
    for page, states in zip(parsed, walked, strict=True):
        text = text_of(page, states, best) if any(t[2] in template for t in page) else ""
        if not text:  # built otherwise, or nothing to compare with: the tags that the page has once
            counts = Counter(t[2] for t in page if t[0] != "text")
            key, own = main_element([page], {k for k, n in counts.items() if n == 1})
            text = text_of(page, own[0], key)
        out.append(text)
    return out


def group(frame: pd.DataFrame) -> pd.DataFrame:
    pages = [h if isinstance(h, str) else "" for h in frame["html"]]
    hosts: dict[str, list[int]] = defaultdict(list)
    for i, host in enumerate(frame["_host"]):
        hosts[host].append(i)
    texts = [""] * len(pages)
    for own in hosts.values():
        for i, text in zip(own, extract_group([pages[i] for i in own]), strict=True):
            texts[i] = text
    return pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    rows = pick(pages, "page_id", "url", "html").withColumn("_host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)))
    counts = rows.groupBy("_host").agg(F.count(F.lit(1)).alias("_n"))
    small = F.col("_n") < LEAST
    few = counts.agg(F.coalesce(F.sum(F.when(small, F.col("_n"))), F.lit(0)).alias("n")).first()["n"]
    dealt = counts.select(F.col("_host").alias("_h"), F.when(~small, F.col("_host")).alias("_group"), F.greatest(F.lit(1), F.round(F.when(small, F.lit(few)).otherwise(F.col("_n")) / GROUP)).cast("long").alias("_parts"))
    # As a table its size is known: Spark broadcasts it if it is small, and else splits large hosts in a shuffled join.
    joined = rows.join(written(dealt, "hosts"), F.col("_host") == F.col("_h"))
    # A null group is the pool of small hosts, dealt host by host.
    part = F.pmod(F.when(F.col("_group").isNull(), F.xxhash64("_host")).otherwise(F.xxhash64("page_id", "url", F.length("html"))), F.col("_parts"))
    keyed = joined.select("page_id", "url", "html", "_host", "_group", part.alias("_part"))
    return keyed.groupBy("_group", "_part").applyInPandas(group, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
