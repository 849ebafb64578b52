"""Main text of pages: a tree-structured model over DOM nodes.

Every node is content or not. A node's potential is log-linear in what it is (tag, words of
its class and id, length, share of linked text); a parent-child potential says how the two
labels go together, by the kind of child. Sum-product messages go from the leaves to the
root and back, which gives exact marginals in two passes. A text node is part of the main
text if its marginal is at least one half.

The model is trained by the gradient of the labelled trees' likelihood. Labelled pages are
composed here from hand-labelled pieces (``labelled_pages``), and at most ``MAX_PAGES`` pages of
the table at hand (first by a hash of page_id, up to ``MAX_LENGTH`` characters of html) that
mark their article themselves; each of these is shown a second time with those marks
taken away, so that the model doesn't lean on them alone.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm import dom
from auditlake.llm.common import arrow_map

MAX_PAGES = 300
MAX_LENGTH = 100_000
EPOCHS = 6
RATE = 0.3
ASIDE = frozenset("nav aside footer header form button select textarea head dialog menu".split())
MARKS = ("article", "main", "nav", "aside", "footer", "header", "section")


def features(page: dom.Page) -> tuple[list[list[str]], list[int]]:
    """Names of each node's features, and its kind: 0 text, 1 inline, 2 block."""
    n = len(page.tag)
    length, linked = [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = page.tag[i] == "a" or in_link[page.parent[i]]
        if not page.tag[i]:
            length[i] = len(page.text[i].split())
            linked[i] = length[i] if in_link[i] else 0
    for i in range(n - 1, 0, -1):
        length[page.parent[i]] += length[i]
        linked[page.parent[i]] += linked[i]
    names, kinds = [], []
    for i in range(n):
        tag, size = page.tag[i], length[i].bit_length()
        if tag:
            own = [f"tag {tag}", f"size {size}", f"links {int(4 * linked[i] / max(1, length[i]))}"]
            own += [f"word {w}" for w in page.words[i]]
            kinds.append(1 if tag in dom.INLINE else 2)
        else:
            own = [f"in {page.tag[page.parent[i]]}", f"words {size}", "linked" if in_link[i] else "plain"]
            own.append("stops" if any(c in page.text[i] for c in ".!?") else "no stops")
            kinds.append(0)
        names.append(own)
    return names, kinds


class TreeModel:
    """Weights of features, and log potentials [kind][parent label][child label]."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.pair = [[[0.5, -0.5], [0.0, 0.0]] for _ in range(3)]
        self._squares: dict = {}

    def messages(self, page: dom.Page, names, kinds):
        """Upward and downward odds of each node, and the child's odds within its pair."""
        n, weights, parent = len(names), self.weights, page.parent
        pair = [[[math.exp(v) for v in row] for row in table] for table in self.pair]
        own = [math.exp(max(-30.0, min(30.0, sum([weights.get(f, 0.0) for f in fs])))) for fs in names]
        up, sent = own[:], [1.0] * n
        for i in range(n - 1, 0, -1):
            (p00, p01), (p10, p11) = pair[kinds[i]]
            r = up[i]
            sent[i] = (p10 + p11 * r) / (p00 + p01 * r)
            up[parent[i]] = min(1e100, max(1e-100, up[parent[i]] * sent[i]))
        belief = up[:]
        for i in range(1, n):
            (p00, p01), (p10, p11) = pair[kinds[i]]
            above = belief[parent[i]] / sent[i]
            belief[i] = min(1e100, max(1e-100, up[i] * (p01 + p11 * above) / (p00 + p10 * above)))
        return pair, up, sent, belief

    def marginals(self, page: dom.Page) -> list[float]:
        names, kinds = features(page)
        belief = self.messages(page, names, kinds)[3]
        return [b / (1 + b) for b in belief]

    def learn(self, page: dom.Page, labels: list[int]) -> None:
        """One step up the likelihood of the labelled tree."""
        names, kinds = features(page)
        pair, up, sent, belief = self.messages(page, names, kinds)
        change: dict = {}
        for i, fs in enumerate(names):
            gap = labels[i] - belief[i] / (1 + belief[i])
            for f in fs:
                change[f] = change.get(f, 0.0) + gap
            if i:
                table, r = pair[kinds[i]], up[i]
                above = belief[page.parent[i]] / sent[i]
                joint = [[table[0][0], table[0][1] * r], [above * table[1][0], above * table[1][1] * r]]
                total = sum(map(sum, joint))
                for a in (0, 1):
                    for b in (0, 1):
                        seen = labels[page.parent[i]] == a and labels[i] == b
                        key = (kinds[i], a, b)
                        change[key] = change.get(key, 0.0) + seen - joint[a][b] / total
        for key, g in change.items():
            self._squares[key] = square = self._squares.get(key, 0.1) + g * g
            step = RATE * g / math.sqrt(square)
            if isinstance(key, tuple):
                kind, a, b = key
                self.pair[kind][a][b] += step
            else:
                self.weights[key] = self.weights.get(key, 0.0) * 0.9999 + step


def spread_up(page: dom.Page, labels: list[int]) -> list[int]:
    """An element is content if a text below it is."""
    for i in range(len(labels) - 1, 0, -1):
        if labels[i]:
            labels[page.parent[i]] = 1
    return labels


def own_marks(page: dom.Page) -> list[int] | None:
    """Labels of a page that marks its article; None if it doesn't."""
    state, labels, any_ = [0], [0], False
    for i in range(1, len(page.tag)):
        above, tag = state[page.parent[i]], page.tag[i]
        state.append(-1 if above < 0 or tag in ASIDE else 1 if tag in ("article", "main") else above)
        labels.append(int(not tag and state[i] > 0 and bool(page.text[i].strip())))
        any_ |= bool(labels[i])
    return spread_up(page, labels) if any_ else None


WORDS = "ar bel cor den el fan gor hin is jan kol lem mon nor ol pan ris sol tan un ver wil yor zan".split()
# Pieces of pages labelled by hand; %s is running text.
CONTENT = [
    "<p>%s</p>", "<p>%s<br>%s</p>", "<h1>%t</h1>", "<h2>%t</h2><p>%s</p>", "<h3>%t</h3>", "<blockquote><p>%s</p></blockquote>",
    "<ul><li>%s</li><li>%s</li></ul>", "<p>%s <a href='x'>%t</a> %s</p>", "<pre>%s</pre>", "<div><p>%s</p><p><b>%s</p></div>",
    "<table><tr><td>%t</td><td>%s</td></tr></table>", "<figure><figcaption>%s</figcaption></figure>", "<p>%t</p>", "%s",
]
HOLDERS = [
    "<article>%c</article>", "<main>%c</main>", "<div class='post-content'>%c</div>", "<div id='content'>%c</div>",
    "<section class='story'>%c</section>", "<div class='entry'>%c</div>", "<article class='post'>%c</article>",
    "<div class='article-body'>%c</div>", "<main><article>%c</article></main>", "<div>%c</div>", "<div id='main'>%c</div>",
]
LINKS = "<ul><li><a href='a'>%t</a></li><li><a href='b'>%t</a></li><li><a href='c'>%t</a></li></ul>"
OTHER = [
    f"<nav>{LINKS}</nav>", f"<div class='menu'>{LINKS}</div>", f"<ul class='nav'><li><a>%t</a></li></ul>", f"<div id='navigation'>{LINKS}</div>",
    "<header><h1>%t</h1><p>%s</p></header>", "<div class='header'>%t</div>", "<header class='site'><a>%t</a> %t</header>", "<div id='masthead'>%t</div>",
    "<footer>&copy; %t %s</footer>", "<div class='footer'><p>%s</p></div>", "<div id='footer'><p>&copy; %t</p></div>", "<footer><p>%s</p></footer>",
    "<aside><p>%s</p></aside>", "<div class='sidebar'><h3>%t</h3><p>%s</p></div>", "<aside class='related'><h2>%t</h2>" + LINKS + "</aside>",
    "<div class='ad'>%s</div>", "<div class='ads banner'><p>%s</p></div>", "<div class='advert'>%s</div>", "<div class='advertisement'><p>%s</p></div>",
    "<div class='sponsored promo'><a>%t</a> %s</div>", "<section class='promo'><p>%s</p></section>",
    "<div class='cookie notice'><p>%s</p><button>%t</button></div>", "<div id='cookie-banner'>%s</div>", "<div class='notice'>%s</div>",
    "<div class='alert'>%s</div>", "<div class='consent popup'>%s</div>", "<div role='alert'>%s</div>", "<div class='gdpr modal'><p>%s</p></div>",
    "<form><label>%t</label><input><button>%t</button></form>", "<form class='search'>%t</form>", "<form class='newsletter subscribe'><p>%s</p></form>",
    "<div class='login'><form><p>%s</p><select><option>%t</option></select></form></div>", "<div class='newsletter signup'><p>%s</p></div>",
    "<div class='comments'><h3>%t</h3><div class='comment'><p>%s</p></div><div class='comment'><p>%s</p></div></div>",
    "<section id='comments'><p>%s</p><p>%s</p></section>", "<ol class='comment-list'><li><p>%s</p></li></ol>", "<div id='disqus' class='reply'>%s</div>",
    "<div class='share social'><a>%t</a><a>%t</a></div>", "<div class='breadcrumb'><a>%t</a> / <a>%t</a></div>", "<div class='widget'><p>%s</p></div>",
    "<div class='pagination'><a>1</a><a>2</a></div>", "<div class='tags meta'><a>%t</a></div>", "<div class='recommended'><p>%s</p>" + LINKS + "</div>",
    "<p hidden>%s</p>", "<button>%t</button>", "<div role='navigation'>" + LINKS + "</div>", "<dialog><p>%s</p></dialog>", "<div role='complementary'>%s</div>",
]


def labelled_pages(count: int = 400, seed: int = 5) -> list[tuple[dom.Page, list[int]]]:
    """Pages put together from the labelled pieces."""
    rng = random.Random(seed)

    def words(n: int) -> str:
        return " ".join("".join(rng.choices(WORDS, k=rng.randint(1, 3))) for _ in range(n)).capitalize()

    def filled(piece: str) -> str:
        while "%s" in piece:
            text = ". ".join(words(rng.randint(3, 25)) for _ in range(rng.randint(1, 6)))
            piece = piece.replace("%s", text + ".", 1)
        while "%t" in piece:
            piece = piece.replace("%t", words(rng.randint(1, 8)), 1)
        return piece

    def marked(piece: str, label: int) -> str:
        return f"<mark data-y={label}>{piece}</mark>"

    pages = []
    for _ in range(count):
        others = [marked(filled(rng.choice(OTHER)), 0) for _ in range(rng.randint(3, 9))]
        body = [marked(filled(rng.choice(CONTENT)), 1) for _ in range(rng.randint(1, 8))]
        for piece in others[: rng.randint(0, 2)]:  # some stand within the article
            body.insert(rng.randint(0, len(body)), piece)
        rest = others[2:]
        cut = rng.randint(0, len(rest))
        parts = [*rest[:cut], rng.choice(HOLDERS).replace("%c", "".join(body)), *rest[cut:]]
        if rng.random() < 0.4:
            parts = [rng.choice(["<div id='page'>", "<div class='wrapper'>", "<div>"]), *parts, "</div>"]
        title = f"<head><title>{words(5)}</title></head>"
        pages.append(unmarked(dom.read(f"<html>{title}<body>{''.join(parts)}</body></html>")))
    return pages


def unmarked(page: dom.Page) -> tuple[dom.Page, list[int]]:
    """The page without its label elements, and the labels that they gave."""
    out, number, given, labels = dom.Page(), {0: 0}, {0: 0}, [0]
    for i in range(1, len(page.tag)):
        up = page.parent[i]
        if page.tag[i] == "mark":
            number[i], given[i] = number[up], int("data-y=1" in page.attributes[i])
            continue
        given[i] = given[up]
        number[i] = out.add(page.tag[i], number[up], page.words[i], page.text[i])
        labels.append(int(not page.tag[i] and given[i] and bool(page.text[i].strip())))
    return out, spread_up(out, labels)


def without_marks(page: dom.Page) -> dom.Page:
    out = dom.Page()
    out.parent, out.words, out.text = page.parent, page.words, page.text
    out.tag = ["div" if t in MARKS else t for t in page.tag]
    return out


def train(pages: DataFrame, max_pages: int = MAX_PAGES) -> TreeModel:
    """Weights from the composed pages and a bounded sample of ``pages``."""
    sample = (
        pages.filter(F.col("html").isNotNull() & (F.length("html") <= MAX_LENGTH))
        .select("page_id", "html")
        .orderBy(F.xxhash64("page_id"), "page_id", F.xxhash64("html"))
        .limit(max_pages)
    )
    examples = labelled_pages()
    for row in sample.collect():
        page = dom.read(row["html"])
        labels = own_marks(page)
        if labels:
            examples += [(page, labels), (without_marks(page), labels)]
    rng, model = random.Random(3), TreeModel()
    for _ in range(EPOCHS):
        rng.shuffle(examples)
        for page, labels in examples:
            model.learn(page, labels)
    return model


def main_text(model: TreeModel, source: str | None) -> str:
    page = dom.read(source)
    unseen = dom.hidden(page)
    likely = model.marginals(page)
    shown = [not u and p >= 0.5 for u, p in zip(unseen, likely)]
    return "\n\n".join(dom.blocks(page, shown))


def extract(pages: DataFrame, model: TreeModel) -> DataFrame:
    """(page_id, url, text, n_chars) of every row, from its whole html.

    Other columns are ignored whatever their names. A null or empty html, and one without main
    text, give an empty text; html that isn't well formed is read as far as it goes. Repeated
    rows give repeated results, an empty table none; page_id and url are passed on, nulls too.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a weight for each name seen in training

    def run(batches):
        for batch in batches:
            texts = [main_text(shared.value, h) for h in batch["html"].to_pylist()]
            yield {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": list(map(len, texts))}

    return arrow_map(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
