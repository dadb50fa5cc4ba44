"""Markup left in text blocks: finding it and turning it into clean text.

A text becomes a tree of nodes: everything that could be a mark of HTML,
Markdown, wiki or LaTeX, with what stands between an opening and a closing
mark as its children. Boosted trees score every node from its form, attribute
tokens, depth, siblings and the density of its subtree. The labels are then
decoded from the top: where an element is content (a tag inside code), so is
everything in it that belongs to the same notation, and where an element is
the mark of code, what it holds is content; the most likely labelling without
such contradictions wins.

``html`` and ``markdown`` of a block, where its text is what is left of them,
give the structure that the text has lost.

The model is fitted on the driver on TRAINING_TEXTS texts written by
``training_texts``, with the place of every mark known.
"""

from __future__ import annotations

import html as _html
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import ship_package

from .trees import BoostedTrees

#: Labelled texts that the classifier is fitted on.
TRAINING_TEXTS = 3_000
#: Element names of HTML, and wiki tags, whose marks are markup wherever they stand in prose.
TAGS = frozenset(
    "a abbr article aside b big blockquote body br caption center cite code col colgroup dd del details div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i img input"
    " ins kbd label li link main mark math meta nav nowiki ol option p pre q ref s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea"
    " tfoot th thead title tr tt u ul var video acronym dfn bdo button dir fieldset iframe legend noscript rp rt ruby wbr".split()
)
_KINDS = (
    ("comment", r"<!--.*?(?:-->|\Z)"),
    ("tag", r"</?[A-Za-z][A-Za-z0-9]*(?:\s+[^<>\n]*|\s*)/?>"),
    ("tag_open_left", r"<(?:/?[A-Za-z][A-Za-z0-9]*)(?:\s+[A-Za-z-]+\s*=\s*(?:\"[^\"<>]*\"?|'[^'<>]*'?|[^\s<>]+))+\s*/?(?=\s|\Z|<)"),
    ("entity", r"&(?:\#\d{2,6}|\#[xX][0-9a-fA-F]{2,6}|[A-Za-z][A-Za-z0-9]{1,7});"),
    ("fence", r"```[A-Za-z]*|~~~[A-Za-z]*"),
    ("begin_end", r"\\(?:begin|end)\s*\{[^{}\n]*\}(?:\{[^{}\n]*\}|\[[^\[\]\n]*\])*"),
    ("tex_line", r"\\\\(?:\s*\\hline)?|\\hline\b"),
    ("tex_math", r"\\[()\[\]]|\$\$"),
    ("tex_dollar", r"(?<![A-Za-z0-9_$\\])\$[^\s$\d](?:[^$\n]{0,80}[^\s$])?\$(?![A-Za-z0-9_$])"),
    ("tex_command", r"~?\\[A-Za-z]+\*?(?:\[[^\[\]\n]*\])?(?:\{[^{}\n]*\})*"),
    ("tex_group", r"\{\\[a-z]+\s[^{}\n]*\}"),
    ("tex_tie", r"(?<=[\p{L}.])~(?=[\p{L}\\])"),
    ("tex_quote", r"``(?=[^`\s])[^`'\n]{1,80}''"),
    ("wiki_table", r"^[ \t]*(?:\|\}|\|-+[^\n|]*|\|\+)[ \t]*|\{\|[^\n]*|\|\}"),
    ("wiki_cell", r"(?<=\S )\|\|(?= \S)|\|\||^![ \t]*(?=\S)"),
    ("wiki_template", r"\{\{[^{}\n]*\}\}|\{\{|\}\}"),
    ("wiki_link", r"!?\[\[[^\[\]\n]*\]\]|\[\[|\]\]"),
    ("wiki_ext", r"\[(?:(?:https?|ftp)://|\.{0,2}/[\w.-]+/)[^\s\[\]]+(?:\s+[^\[\]\n]*)?\]"),
    ("md_image_link", r"!?\[[^\[\]\n]*\]\((?:[^()\n]*)\)"),
    ("md_ref_link", r"\[[^\[\]\n]+\]\[[^\[\]\n]*\]|^\s*\[[^\[\]\n]+\]:[ \t]+\S+"),
    ("md_footnote", r"\[\^[^\[\]\s]+\]:?"),
    ("md_task", r"^[ \t]*[-*+][ \t]+\[[ xX]\](?=[ \t])"),
    ("md_rule", r"^[ \t]*(?:\*[ \t]*){3,}$|^[ \t]*(?:-[ \t]*){3,}$|^[ \t]*(?:_[ \t]*){3,}$"),
    ("md_setext", r"(?<=\S[ \t]*\n)[ \t]*(?:={3,}|-{3,})[ \t]*$"),
    ("wiki_heading", r"^[ \t]*={2,6}[ \t]*(?=[^\s=])|(?<=[^\s=])[ \t]*={2,6}[ \t]*$"),
    ("md_heading", r"^[ \t]*\#{1,6}(?=[ \t]+\S)"),
    ("md_table_rule", r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$"),
    ("md_row", r"^[ \t]*\|(?=[^\n]*\|)|(?<=[^\n|])\|(?=[^\n|])|\|[ \t]*$"),
    ("md_quote", r"^[ \t]*>+(?=[ \t])"),
    ("wiki_bold", r"'{2,5}"),
    ("md_strong", r"\*{2,3}(?=\S)|(?<=\S)\*{2,3}|^\*{2}(?=[ \t])"),
    ("md_bold_", r"(?<![\p{Latin}\d_])_{2}(?=\S)|(?<=\S)_{2}(?![\p{Latin}\d_])"),
    ("md_strike", r"~~"),
    ("md_code", r"`"),
    ("md_emphasis", r"(?<![\p{Latin}\d_*])[*_](?=[^\s*_])|(?<=[^\s*_])[*_](?![\p{Latin}\d_*])"),
    ("md_bullet", r"^[ \t]*[*+][ \t]+(?=\S)|^[ \t]*-[ \t]+(?=\S)"),
    ("tex_amp", r"(?<= )&(?= )"),
    ("angle", r"[<>]"),
    ("star", r"\*"),
    ("hash", r"\#"),
    ("brace", r"[{}]"),
    ("bracket", r"\[[^\[\]\n]*\]"),
    ("dollar", r"\$"),
    ("caret", r"\^|_|~"),
    ("amp", r"&"),
    ("backslash", r"\\"),
)
KINDS = [k for k, _ in _KINDS]
_ANY = regex.compile("|".join(f"(?P<{k}>{p})" for k, p in _KINDS), regex.M | regex.S)
#: A text without any of these has no node.
_SIGNS = r"[<>&*_#`|\[\]{}\\$~^]|''|==|^[ \t]*[-+][ \t]|--"
_SIGN = regex.compile(_SIGNS, regex.M)
_NAME = regex.compile(r"</?([A-Za-z][A-Za-z0-9]*)")
_TEX = regex.compile(r"\\([A-Za-z]+)")
_FAMILY = {"tag": 1, "tag_open_left": 1, "comment": 1, "entity": 1, "begin_end": 2, "tex_command": 2, "tex_math": 2, "tex_line": 2, "tex_group": 2}
#: Elements that hold code as it is, and the notations that have no marks in them.
_CODE_TAGS = frozenset("code pre source tt kbd samp nowiki math".split())
_VERBATIM = regex.compile(r"\\begin\s*\{(?:verbatim|lstlisting|minted|equation|align|math)\*?\}")
_NOT_IN_CODE = frozenset(k for k, _ in _KINDS if k.startswith(("md_", "wiki_", "fence", "tex_quote", "tex_tie")))
#: TeX commands of documents, as opposed to those of formulas.
_TEX_DOCUMENT = frozenset("section subsection subsubsection paragraph chapter part textbf textit texttt emph href url cite ref label footnote item hline caption title author includegraphics underline textsc it bf".split())
_BLOCKS = ("paragraph", "heading", "list", "list_item", "table", "code", "formula")
#: How much the form alone says: a lone sign, a mark that needs its mate, a construct of its own.
_LONE = frozenset("angle star hash brace bracket dollar caret amp backslash tex_amp md_row".split())
_PAIRED = frozenset("md_emphasis md_bold_ md_strong md_strike md_code wiki_bold wiki_heading wiki_cell tex_dollar md_bullet md_heading md_quote tex_tie tex_command tag".split())
FEATURES = len(KINDS) + len(_BLOCKS) + 27


class Node:
    __slots__ = ("children", "close", "end", "kind", "mate", "name", "parent", "start", "text")

    def __init__(self, kind: str, start: int, end: int, text: str):
        self.kind, self.start, self.end, self.text = kind, start, end, text
        self.parent: int = -1
        self.mate: int = -1
        self.children: list[int] = []
        self.close = text.startswith("</") or text.startswith("\\end")
        m = _NAME.match(text) if kind in ("tag", "tag_open_left") else _TEX.search(text) if "\\" in text else None
        self.name = m.group(1).lower() if m else ""


def parse(text: str) -> list[Node]:
    """Nodes of a text in order, with mates (closing or opening mark) and parents."""
    nodes = [Node(m.lastgroup, m.start(), m.end(), m.group()) for m in _ANY.finditer(text)]
    open_: list[int] = []
    toggles: dict[tuple, int] = {}
    for i, n in enumerate(nodes):
        if n.kind in ("tag", "tag_open_left", "begin_end"):
            if n.close:
                for at in range(len(open_) - 1, -1, -1):
                    if nodes[open_[at]].name == n.name or n.kind == "begin_end" and nodes[open_[at]].kind == "begin_end":
                        n.mate, nodes[open_[at]].mate = open_[at], i
                        del open_[at:]
                        break
            n.parent = open_[-1] if open_ else -1
            if not n.close and not n.text.rstrip(">").endswith("/"):
                open_.append(i)
        else:
            n.parent = open_[-1] if open_ else -1
            if n.kind in ("md_strong", "md_bold_", "md_strike", "md_code", "wiki_bold", "fence", "md_emphasis", "tex_math", "wiki_heading"):
                key = (n.kind, n.parent, n.text.strip()[:1] if n.kind in ("md_emphasis", "md_strong") else "")
                if key in toggles:
                    n.mate = toggles.pop(key)
                    nodes[n.mate].mate = i
                else:
                    toggles[key] = i
    for i, n in enumerate(nodes):
        if n.parent >= 0:
            nodes[n.parent].children.append(i)
    return nodes


def features(text: str, block: str | None, nodes: list[Node]) -> np.ndarray:
    x = np.zeros((len(nodes), FEATURES), np.float32)
    length = max(1, len(text))
    counts: dict[str, int] = {}
    for n in nodes:
        counts[n.kind] = counts.get(n.kind, 0) + 1
    marks = sum(n.end - n.start for n in nodes)
    first, last = len(text) - len(text.lstrip()), len(text.rstrip())
    kind_at = {k: i for i, k in enumerate(KINDS)}
    for i, n in enumerate(nodes):
        row = x[i]
        row[kind_at[n.kind]] = 1
        if block in _BLOCKS:
            row[len(KINDS) + _BLOCKS.index(block)] = 1
        before, after = text[n.start - 1 : n.start], text[n.end : n.end + 1]
        depth, p = 0, n.parent
        while p >= 0 and depth < 20:
            depth, p = depth + 1, nodes[p].parent
        inner = text[n.end : nodes[n.mate].start] if n.mate > i else ""
        inside = sum(nodes[c].end - nodes[c].start for c in n.children)
        row[len(KINDS) + len(_BLOCKS) :] = (
            n.name in TAGS,
            n.name in _TEX_DOCUMENT,
            n.kind == "tag" and n.name not in TAGS,
            n.close,
            n.mate >= 0,
            "=" in n.text,
            regex.search(r"class|href|src|lang|id\s*=|color|name", n.text) is not None,
            min(n.end - n.start, 60),
            depth,
            len(n.children),
            inside / max(1, len(inner)),
            counts[n.kind],
            sum(1 for c in nodes[n.parent].children if nodes[c].kind == n.kind) if n.parent >= 0 else counts[n.kind],
            marks / length,
            n.start == first,
            n.end == last,
            before == "" or before in "\r\n",
            after == "" or after in "\r\n",
            before.isspace(),
            after.isspace(),
            before.isalnum(),
            after.isalnum(),
            after.isdigit() or before.isdigit(),
            regex.search(r"\d", n.text) is not None and n.kind in ("bracket", "brace", "entity", "md_footnote"),
            " " in n.text,
            min(len(inner), 200),
            0 if n.kind in _LONE else 1 if n.kind in _PAIRED else 2,
        )
    return x


def code_scopes(nodes: list[Node]) -> dict[int, int]:
    """For nodes inside code: the mark that opens it. In Markdown code nothing is a mark, in other code nothing of Markdown or a wiki."""
    out: dict[int, int] = {}
    upto, opened, every = -1, -1, False
    for i, n in enumerate(nodes):
        if i < upto:
            if every or n.kind in _NOT_IN_CODE:
                out[i] = opened
        elif n.mate > i and (n.kind in ("md_code", "fence") or (n.kind == "tag" and n.name in _CODE_TAGS) or (n.kind == "begin_end" and _VERBATIM.match(n.text))):
            upto, opened, every = n.mate, i, n.kind in ("md_code", "fence")
    return out


def decode(nodes: list[Node], p: np.ndarray) -> np.ndarray:
    """The most likely labels in which nothing of a notation is markup inside an element of it that is content,
    nor inside an element that is the mark of code.

    An element and its closing mark share one label.
    """
    p = np.clip(p, 1e-6, 1 - 1e-6)
    yes, no = np.log(p), np.log(1 - p)
    own_yes, own_no = yes.copy(), no.copy()
    for i, n in enumerate(nodes):
        if n.mate > i:
            own_yes[i] += yes[n.mate]
            own_no[i] += no[n.mate]
    scopes = code_scopes(nodes)
    for c, i in scopes.items():
        own_yes[i] += min(no[c] - yes[c], 0.0)  # what it costs that c is content then
    best_yes, best_no, only_no = (np.zeros(len(nodes)) for _ in range(3))
    family = [_FAMILY.get(n.kind, 0) for n in nodes]
    skip = [0 <= n.mate < i for i, n in enumerate(nodes)]
    for i in range(len(nodes) - 1, -1, -1):  # children come after their parent
        if skip[i]:
            continue
        kids = [c for c in nodes[i].children if not skip[c]]
        best_yes[i] = own_yes[i] + sum(max(best_yes[c], best_no[c]) for c in kids)
        best_no[i] = own_no[i] + sum(only_no[c] if family[c] == family[i] and family[i] else max(best_yes[c], best_no[c]) for c in kids)
        only_no[i] = best_no[i]
    label = np.zeros(len(nodes), bool)
    for i, n in enumerate(nodes):
        if skip[i]:
            label[i] = label[n.mate]
            continue
        barred = (n.parent >= 0 and family[i] and family[n.parent] == family[i] and not label[n.parent]) or (i in scopes and label[scopes[i]])
        label[i] = not barred and best_yes[i] > best_no[i]
    return label


def clean_text(text: str, nodes: list[Node], label: np.ndarray, block: str | None = None) -> str:
    """The text with every mark replaced by what it stands for: headings and list items keep a plain
    mark of their own, table cells become tabs; of code and formulas every character stays."""
    out: list[tuple[str, bool]] = []  # what is written, and whether it is code
    at, code_upto = 0, len(nodes) if block in ("code", "formula") else -1
    for i, n in enumerate(nodes):
        if not label[i] or n.start < at:
            continue
        raw = i <= code_upto
        out.append((text[at : n.start], raw))
        at = n.end
        begins = not text[: n.start].strip(" \t") or text[: n.start].rstrip(" \t")[-1:] in ("\n", "\r")
        out.append(("" if begins and n.kind == "md_row" else _plain(n), raw))
        if begins and n.kind in ("md_table_rule", "wiki_table") and text[at : at + 1] == "\n":
            at += 1  # the line of a rule goes with it
        if n.kind == "tag" and n.name in ("script", "style") and not n.close and n.mate > i:
            at = nodes[n.mate].start
        if n.mate > max(i, code_upto) and (n.kind in ("md_code", "fence") or (n.kind == "tag" and n.name in _CODE_TAGS) or (n.kind == "begin_end" and _VERBATIM.match(n.text))):
            code_upto = n.mate
    out.append((text[at:], block in ("code", "formula")))
    done, plain = [], []
    for s, raw in [*out, ("", True)]:
        if not raw:
            plain.append(s)
            continue
        done += [_spaced("".join(plain)), s]
        plain = []
    s = "".join(done)
    return s.strip("\r\n") if block == "code" else s.strip()


def _spaced(s: str) -> str:
    s = regex.sub(r" *\t *", "\t", s)
    s = regex.sub(r"[ \t]+\n", "\n", regex.sub(r"\n{3,}", "\n\n", s))
    return regex.sub(r"(?<=\S) {2,}(?=\S)", " ", s)


_LETTERS = regex.compile(r"[^\p{L}\p{N}]+")


def with_source(clean: str, sources: list[str | None], block: str | None, trees: BoostedTrees) -> str:
    """The clean text of the first source (html, markdown) that holds the same letters and digits, else ``clean``.

    A source that says something else is that of another state of the block.
    """
    own = _LETTERS.sub("", clean)
    for source in sources:
        if source and source.strip():
            ((nodes, label),) = label_texts([source], [block], trees)
            whole = clean_text(source, nodes, label, block)
            if _LETTERS.sub("", whole) == own:
                return whole
    return clean


def _plain(n: Node) -> str:
    t, k = n.text, n.kind
    if k == "tag":
        if n.name in ("br", "tr", "div", "p", "table", "ul", "ol", "pre") and (n.name == "br" or n.close):
            return "\n"
        if n.name == "li":
            return "\n" if n.close else "- "
        if n.name in ("td", "th"):
            return "\t" if n.close else ""
        if n.name in ("h1", "h2", "h3", "h4", "h5", "h6") and not n.close:
            return "#" * int(n.name[1]) + " "
        return ""
    if k == "entity":
        return _html.unescape(t)
    if k == "begin_end":
        return ""
    if k == "tex_line":
        return "\n"
    if k == "tex_dollar":
        return t[1:-1]
    if k in ("tex_command", "tex_group"):
        if n.name == "item":
            return "- "
        if n.name in ("section", "chapter", "part"):
            return "# " + _argument(t)
        if n.name in ("subsection", "subsubsection", "paragraph"):
            return "#" * (2 + n.name.count("sub") - (n.name == "subsection")) + " " + _argument(t)
        if n.name in ("cite", "ref", "label", "hline", "includegraphics"):
            return ""
        return regex.sub(r"^\{\\[a-z]+\s|\}$", "", t) if k == "tex_group" else _argument(t)
    if k == "tex_tie":
        return " "
    if k == "tex_quote":
        return t[2:-2]
    if k in ("wiki_cell", "md_row", "tex_amp"):
        return "\t" if t.strip() in ("||", "|", "&") else ""
    if k == "wiki_template":
        return regex.sub(r"^[^|]*\|(?:[^=|]*=)?", "", t.strip("{}")) if "|" in t else ""
    if k == "wiki_link":
        inner = t.strip("![]")
        return "" if inner.startswith("Category:") else inner.rsplit("|", 1)[-1]
    if k == "wiki_ext":
        return t[1:-1].partition(" ")[2]
    if k in ("md_image_link", "md_ref_link"):
        m = regex.match(r"!?\[([^\[\]]*)\]", t)
        return m.group(1) if m else ""
    if k == "md_heading":
        return t
    if k == "wiki_heading":
        return "#" * (t.count("=") - 1) + " " if n.mate < 0 or n.mate > -1 and t.lstrip().startswith("=") and t.rstrip() != t else ""
    if k in ("md_bullet", "md_task"):
        return "- "
    return ""


def _argument(t: str) -> str:
    parts = regex.findall(r"\{([^{}]*)\}", t)
    return parts[-1] if parts else ""


# --- labelled texts -------------------------------------------------------------------------------------------------------------

_WORDS = "filter report schedule baseline clause Fristen Anlagen Quittungen Verträge copies règlements pompes délais 合同 阈值 流程 工单 appendix voucher sensor 索引 Rabatte journaux".split()
_MARKS = (
    "<b>{w}</b>", "<i>{w}</i>", "<em>{w}</em>", "<p>{w} {w}", "{w}</p>", "<br>", "<BR>", "<br/>", '<span class="x">{w}</span>', "<td>{w}", "<td>{w}</td>", "</td></tr>", "<tr>", "<div id=s1>{w}", "</div>", "<code>{w}</code>",
    "<script>var q=1;</script>", "<!-- rev 2 -->", "<a href='https://a.example/x'>{w}</a>", '<img src="/f/a" alt="{w}">', "<font color=red>{w}", "</font>", "<sup>2</sup>", "<li>{w}", "{w}</li>", "<ul>", "</ul>", "<nowiki>{w}</nowiki>",
    '<ref name="a"/>', "<ref>{w}</ref>", "<h2>{w}</h2>", "<th>{w}</th>", "<blockquote>{w}", "<u>{w}</u>", "<strong>{w}</strong>", "<hr>", "&nbsp;", "&amp;", "&lt;i&gt;{w}&lt;/i&gt;", "&hellip;", "&quot;{w}&quot;", "&#8217;s", "&eacute;", "&#x27;", "&amp;nbsp;",
    "**{w}**", "***{w}***", "__{w}__", "*{w}*", "_{w}_", "~~{w}~~", "`{w}`", "[{w}](/f/a)", "![{w}](../a/b.html)", "[{w}][ref-2]", "[{w}](https://a.example)", "[^3]", "[^note]", "\n```\n{w}\n```\n", "\n### {w}\n\n", "\n# {w}\n", "\n> {w}\n", "\n- [ ] {w}",
    "\n- [x] {w}\n", "\n{w}\n========\n", "\n{w}\n-------\n", "\n* * *\n", "\n---\n", "\n| {w} | {w} |\n|---|---|\n| 4 | {w} |\n", "\n* {w}\n* {w}\n", "\n+ {w}", "**{w}", "{w}**", "`{w}", "__{w}",
    "[/files/ab/c-{n} {w}]", "[../ab/c.html {w}]", "[[{w}]]", "[[Main page|{w}]]", "[[File:a.png|thumb|{w}]]", "[[Category:{w}]]", "{{note|{w}}}", "{{cite|title={w}}}", "[https://a.example/x {w}]", "'''{w}'''", "''{w}''", "\n== {w} ==\n", "\n=== {w} ===\n", '\n{| class="grid"\n! {w}\n|-\n| 4\n|}\n', "\n|}\n", "\n|-\n| {w} || {w}\n", "{{{w}}}",
    "\\section{{w}}", "\\subsection{{w}}", "\\textbf{{w}}", "\\emph{{w}}", "\\texttt{{w}}", "\\href{/f/a}{{w}}", "~\\cite{a24}", "~\\ref{tab:1}", "\\label{sec:{w}}", "\\footnote{{w}}", "\\paragraph{{w}}", "{w} \\\\ \\hline", "\\({w}\\)", "${w}_{1}$", "{\\it {w}}", "``{w}''",
    "\\begin{itemize}\n\\item {w}\n\\end{itemize}", "\\item {w}", "\\end{itemize}", "\\\\", "\\url{https://a.example}", "\\underline{{w}}", "\\caption{{w}}", "\\begin{center}", "$\\alpha$", "$x^2$", "{w}~{w}",
)
_PLAIN = (
    "(a < b, c > d)", "50 <= n < 80", "x < 3", "y > 10", "n >= 5", "-> {w}", "=> {w}", "{w} -> {w}", "a <-> b", "if x<5", "3<4", "5 * 3 * 2", "4*5", "2 * {n}", "[1]", "[12]", "\n[14]\n", "\n[7]\n", "\n[{n}]\n", "[a]", "[{n}, {n}]", "[sic]", "[...]", "{0}", "{tenant}", "{{n}}", "{name}", "{id}", "${user}",
    "for $40 or $60", "$5", "$ 12.50", "US$ {n}", "$1,200", "C++/C#", "C# and F#", "#4512", "# {n}", "No. #7", "item #{n}", "R&D", "Q&A", "AT&T", "A & B", "{w} & {w}", "snake_case_name", "x_1 = 3", "a_b", "file_name_{n}", "2^10", "10^-3", "~20 ms", "~{n}", "C:\\data\\in",
    "C:\\data\\inbox", "\\\\server\\share", "D:\\new\\text", "/usr/local/bin", "a/b", "<{n} ms", ">{n}", "a|b", "{w} | {w}", "x||y", "~/data", "key=value", "a == b", "x != y", "* {n}", "5'' pipe", "6' 2''", "100%", "e.g. @user", "user@a.example", "https://a.example/x_y?a=1&b=2", "<name>", "<your id>",
    "<tenant>", "<email@a.example>", "--verbose", "-x", "--", "rock'n'roll", "{w}_{w}", "f(x)[0]", "a[1]", "[TBD]", "[{w}]", "{a, b}", "^{n}", "~", "\\d+", "x & y", "1 & 2", "{w}#1", "=", "==",
)
_CODES = ("<config>\n  <limit>{n}</limit>\n</config>", "# set the limit\nexport LIMIT={n}", "retries = {n}\nfor item in queue:\n    push(item, limit={n})", "if (count < {n}) { retry(count + 1); }", "SELECT name FROM ledger WHERE amount > {n};", "def load(path):\n    return read(path)[:{n}]",
    "curl -X POST /jobs/{n} -d @body.json", "a = b * c ** {n}", "<item id=\"{n}\"/>", "x = [1, 2]; y = {'a': 1}", "echo $HOME | grep -v '^#'", "int *p = &q; p->x |= 1 << {n};", "/* {w} */", "__name__ == '__main__'", "<users>\n  <user>{w}</user>\n</users>", "- name: {w}\n  value: {n}", "git log --oneline > out.txt")
_FORMULAS = ("\\frac{a_{n}}{b} = c^2", "\\sum_{i=1}^{{n}} x_i \\le y", "\\sqrt{s^2 + {n}}", "E = m v^{{n}} / 2", "a_1 < b^2", "\\int_0^1 f(x) dx", "x_{{n}} \\geq \\alpha", "\\left( a \\cdot b \\right)", "p \\in [0, 1]")
_WRAPS = {
    "code": ("```sh\n{x}\n```", "```\n{x}\n```", "```\n{x}", "{x}\n```", "<pre>{x}</pre>", "<pre><code>{x}</code></pre>", "<code>{x}</code>", "{x}</code>", "{x}</code></pre>", "<pre><code>{x}", "\\begin{verbatim}\n{x}\n\\end{verbatim}", "{x}\n\\end{verbatim}", '<source lang="sh">\n{x}\n</source>', "{x}\n</source>", "\\begin{lstlisting}\n{x}\n\\end{lstlisting}"),
    "formula": ("$${x}$$", "\\({x}\\)", "\\[{x}\\]", "<math>{x}</math>", '<span class="math">\\({x}\\)</span>', "\\begin{equation}\n{x}\n\\end{equation}", "${x}$", "{x}\n\\end{equation}", "{x}</math>", "{x}$$"),
    "heading": ("# {x}", "## {x}", "### {x}", "<h2>{x}</h2>", '<h3 class="t">{x}</h3>', "{x}</h2>", "== {x} ==", "=== {x} ===", "\\section{{x}}", "\\subsection{{x}}"),
    "list_item": ("<ul><li>{x}</li>", "<li>{x}", "{x}</li></ul>", "* {x}", "+ `{x}`", "* **{x}**", "{x}**", "{x}`", "** '''{x}", "\\begin{itemize}\n\\item {x}\n\\end{itemize}", "\\item {x}", "- {x}", "** {x}"),
    "table": ("<table><tr><td>{x}</td><td>{x}</td></tr></table>", "<tr> {x} <td>{x}", "{x}</td></tr>", "| {x} | {x} |\n|---|---|\n| {x} | {n} |", "| a | b |\n| {x} | {n} |", '{| class="wikitable"\n|-\n| {x} || {n}\n|}', "|-\n| {x} || {n}\n|}", "{x} & {n} \\\\\n{x} & {n} \\\\\n\\end{tabular}", "\\begin{tabular}{lll}\n{x} & {n} \\\\", "{x} & {x} & {n} \\\\", "{x} <td>{n}</td>"),
}


def training_texts(count: int = TRAINING_TEXTS, seed: int = 11):
    """(text, block type, ranges that are markup) of invented blocks, half of them clean."""
    rng = np.random.default_rng(seed)

    def fill(s: str, **more: str) -> str:
        while "{w}" in s:
            s = s.replace("{w}", str(rng.choice(_WORDS)), 1)
        return s.replace("{n}", str(rng.integers(2, 9999)))

    def prose() -> str:
        return " ".join(fill("{w}") for _ in range(rng.integers(3, 12))) + str(rng.choice([".", "。", ";", ""]))

    for _ in range(count):
        block = str(rng.choice(_BLOCKS, p=(0.5, 0.08, 0.08, 0.1, 0.08, 0.08, 0.08)))
        parts: list[tuple[str, bool | None]] = []
        if block in ("code", "formula"):
            body = fill(str(rng.choice(_CODES if block == "code" else _FORMULAS)))
            if rng.random() < 0.55:
                wrap = str(rng.choice(_WRAPS[block]))
                if block == "code" and "<code" in wrap + "<pre" and rng.random() < 0.5 and ("<pre" in wrap or "</code>" in wrap):
                    parts += [(wrap.split("{x}")[0], True), (_html.escape(body, quote=False), None), (wrap.split("{x}")[1], True)]
                else:
                    parts += [(wrap.split("{x}")[0], True), (body, False), (wrap.split("{x}")[1], True)]
            else:
                parts.append((body, False))
        elif block in _WRAPS and rng.random() < 0.5:
            wrap = fill(str(rng.choice(_WRAPS[block])))
            pieces = wrap.split("{x}")
            for k, piece in enumerate(pieces):
                parts.append((piece, True))
                if k < len(pieces) - 1:
                    parts.append((prose() if block != "table" else fill("{w}"), False))
        else:
            dirty = rng.random() < 0.5
            for _ in range(rng.integers(1, 6)):
                said = prose()
                parts.append((said if said[-1] == "。" and rng.random() < 0.7 else said + " ", False))
                if rng.random() < 0.5:
                    parts.append((fill(str(rng.choice(_PLAIN))), False))
                    parts.append((" ", False))
                if dirty and rng.random() < 0.7:
                    parts.append((fill(str(rng.choice(_MARKS))), True))
                    parts.append((str(rng.choice([" ", ""])), False))
        text, ranges = "", []
        for s, mark in parts:
            if mark:
                ranges.append((len(text), len(text) + len(s)))
            elif mark is None:
                ranges += [(len(text) + m.start(), len(text) + m.end()) for m in regex.finditer(r"&(?:lt|gt|amp);", s)]
            text += s
        yield text, block, ranges


@lru_cache(maxsize=1)
def model() -> BoostedTrees:
    xs, ys = [], []
    for text, block, ranges in training_texts():
        nodes = parse(text)
        if nodes:
            xs.append(features(text, block, nodes))
            ys.append([any(n.start < e and n.end > s for s, e in ranges) for n in nodes])
    return BoostedTrees(rounds=60).fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def label_texts(texts: list[str], blocks: list[str | None], trees: BoostedTrees) -> list[tuple[list[Node], np.ndarray]]:
    parsed = [parse(t) for t in texts]
    xs = [features(t, b, n) for t, b, n in zip(texts, blocks, parsed, strict=True) if n]
    p = trees.probability(np.concatenate(xs)) if xs else np.zeros(0)
    out, at = [], 0
    for n in parsed:
        out.append((n, decode(n, p[at : at + len(n)])))
        at += len(n)
    return out


def markup_residue(blocks: DataFrame, key: str = "block_id") -> DataFrame:
    """key, block_type, marks and clean text of every block whose text still has markup.

    Where ``html`` or ``markdown`` of the block holds the same content, its
    structure goes into the clean text; columns that are absent or null leave
    the text alone to tell. Null, empty and markless texts give no row; an
    unknown or null block type counts as none; repeated blocks give a row each
    time; other columns are not read.
    """
    ship_package(blocks.sparkSession)
    shared = blocks.sparkSession.sparkContext.broadcast(model())  # a few hundred numbers a tree
    kind = blocks.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts, types, htmls, markdowns = (batch.column(c).to_pylist() for c in ("text", "block_type", "html", "markdown"))
            at = [i for i, t in enumerate(texts) if _SIGN.search(t)]
            keep, marks, clean = [], [], []
            for s in range(0, len(at), 500):
                own = at[s : s + 500]
                for i, (nodes, label) in zip(own, label_texts([texts[i] for i in own], [types[i] for i in own], shared.value), strict=True):
                    if label.any():
                        keep.append(i)
                        marks.append(int(label.sum()))
                        done = clean_text(texts[i], nodes, label, types[i])
                        whole = [x for x in (htmls[i], markdowns[i]) if x != texts[i]]
                        clean.append(with_source(done, whole, types[i], shared.value))
            own = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column("block_type"), pa.array(marks, pa.int32()), pa.array(clean, pa.string())], [key, "block_type", "marks", "clean"])

    sources = [F.col(c) if c in blocks.columns else F.lit(None).cast("string").alias(c) for c in ("html", "markdown")]
    return blocks.where(F.length("text") > 0).select(key, "block_type", "text", *sources).mapInArrow(run, f"{key} {kind}, block_type string, marks int, clean string")
