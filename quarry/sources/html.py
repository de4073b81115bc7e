"""A converter of HTML to Markdown: headings, paragraphs, nested lists, tables, links, code."""

from __future__ import annotations

import re
from html.parser import HTMLParser

HIDDEN = {"script", "style", "head", "template", "noscript", "svg", "iframe", "object"}
BLOCKS = {
    "p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "form", "figure", "figcaption", "address", "blockquote", "dl", "dt", "dd",
    "title", "body", "html", "fieldset", "details", "summary",
}
HEADINGS = {f"h{i}": "#" * i for i in range(1, 7)}
#: Tags that have no end.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class HtmlConverter:
    """A Converter of readers.converted. The text's encoding is that of its byte order mark or meta tag, else UTF-8 with errors replaced."""

    def markdown(self, content: bytes) -> str:
        return markdown(decoded(content))


def decoded(content: bytes) -> str:
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "replace")
    named = re.search(rb"<meta[^>]{0,200}charset\s*=\s*[\"']?([A-Za-z0-9_.:-]{1,40})", content[:4096], re.IGNORECASE)
    try:
        return content.decode(named[1].decode() if named else "utf-8", "replace")
    except LookupError:
        return content.decode("utf-8", "replace")


def markdown(html: str) -> str:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.text()


class _Table:
    def __init__(self):
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def text(self) -> str:
        rows = [r for r in self.rows if any(r)]
        width = max((len(r) for r in rows), default=0)
        shown = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in rows]
        return "\n".join([*shown[:1], "|" + " --- |" * width, *shown[1:]]) if rows else ""


class _Reader(HTMLParser):
    """Blocks of Markdown, gathered from events. What is inline goes to the innermost open place: a table's cell, or the block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.inline: list[str] = []
        self.prefix = ""
        self.hidden: list[str] = []
        self.lists: list[list] = []  # kind and number of each open list
        self.tables: list[_Table] = []
        self.links: list[tuple[str, int]] = []  # target, place in the inline text
        self.pre = 0

    # Inline text

    def _into(self) -> list[str]:
        return self.tables[-1].cell if self.tables and self.tables[-1].cell is not None else self.inline

    def _flush(self) -> None:
        """End the open block."""
        raw = "".join(self.inline)
        text = raw.strip("\n") if self.pre else re.sub(r"[ \t\r\f\v]*\n[ \t\r\f\v]*", "\n", re.sub(r"[ \t\r\f\v]+", " ", raw)).strip()
        self.inline, self.links = [], []
        if text.strip():
            # Lines after the first stand below the text of a list's item.
            indent = re.match(r" *(?:- |\d+\. )?", self.prefix)[0]
            self.blocks.append(self.prefix + text.replace("\n", "\n" + " " * len(indent)))
            self.prefix = " " * len(indent)
        elif not self.lists:
            self.prefix = ""

    def handle_data(self, data):
        if self.hidden:
            return
        if self.pre:
            self._into().append(data)
        elif not (self.tables and self.tables[-1].cell is None):  # no text between cells
            self._into().append(re.sub(r"\s+", " ", data))

    # Tags

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            if tag == self.hidden[-1] and tag not in VOID:
                self.hidden.append(tag)
            return
        if tag in HIDDEN:
            if tag != "head":
                self.hidden.append(tag)
            return
        given = dict(attrs)
        if tag == "br":
            self._into().append(" " if self.tables else "\n")
        elif tag == "hr":
            self._flush()
            self.blocks.append("---")
        elif tag == "img":
            if given.get("alt"):
                self._into().append(given["alt"])
        elif tag == "a":
            into = self._into()
            self.links.append(((given.get("href") or "").strip(), len(into)))
        elif tag in ("code", "kbd", "tt") and not self.pre:
            self._into().append("`")
        elif tag in ("b", "strong"):
            self._into().append("**")
        elif tag in ("i", "em"):
            self._into().append("*")
        elif self.tables and tag in ("tr", "td", "th"):
            self._row(tag)
        elif tag == "table":
            if self.tables and self.tables[-1].cell is not None:
                self._into().append(" ")
            else:
                self._flush()
            self.tables.append(_Table())
        elif self.tables and self.tables[-1].cell is not None:
            self._into().append(" ")  # blocks inside a cell are one line
        elif tag in HEADINGS:
            self._flush()
            self.prefix += HEADINGS[tag] + " "
        elif tag in ("ul", "ol"):
            self._flush()
            self.lists.append([tag, 0])
        elif tag == "li":
            self._item()
        elif tag == "pre":
            self._flush()
            self.pre += 1
        elif tag in BLOCKS:
            self._flush()

    def handle_endtag(self, tag):
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
            return
        if tag == "a":
            self._link()
        elif tag in ("code", "kbd", "tt") and not self.pre:
            self._into().append("`")
        elif tag in ("b", "strong"):
            self._into().append("**")
        elif tag in ("i", "em"):
            self._into().append("*")
        elif tag == "table" and self.tables:
            self._end_table()
        elif self.tables and tag in ("tr", "td", "th"):
            self._end_cell()
        elif self.tables and self.tables[-1].cell is not None:
            self._into().append(" ")
        elif tag == "pre" and self.pre:
            text = "".join(self.inline).strip("\n")
            self.inline = []
            self.pre -= 1
            if text.strip():
                self.blocks.append("```\n" + text + "\n```")
        elif tag in ("ul", "ol") and self.lists:
            self._flush()
            self.lists.pop()
            self.prefix = ""
        elif tag in HEADINGS or tag == "li" or tag in BLOCKS:
            self._flush()
            if tag in HEADINGS:
                self.prefix = ""

    def _item(self) -> None:
        self._flush()
        depth = max(0, len(self.lists) - 1)
        mark = "- "
        if self.lists and self.lists[-1][0] == "ol":
            self.lists[-1][1] += 1
            mark = f"{self.lists[-1][1]}. "
        self.prefix = "  " * depth + mark

    def _link(self) -> None:
        if not self.links:
            return
        target, start = self.links.pop()
        into = self._into()
        text = re.sub(r"\s+", " ", "".join(into[start:])).strip() if start <= len(into) else ""
        if text and target and not re.match(r"(?i)\s*(javascript|data):", target):
            into[start:] = [f"[{text}]({target.replace(' ', '%20').replace(')', '%29')})"]

    def _row(self, tag: str) -> None:
        self._end_cell()
        table = self.tables[-1]
        if tag == "tr" or not table.rows:
            table.rows.append([])
        if tag != "tr":
            table.cell = []

    def _end_cell(self) -> None:
        table = self.tables[-1]
        if table.cell is not None:
            table.rows[-1].append(re.sub(r"\s+", " ", "".join(table.cell)).strip().replace("|", "\\|"))
            table.cell, self.links = None, []

    def _end_table(self) -> None:
        self._end_cell()
        table = self.tables.pop()
        if self.tables and self.tables[-1].cell is not None:  # a table in a cell: its text
            self.tables[-1].cell.append(" ".join(" ".join(r) for r in table.rows))
        elif table.text():
            self.blocks.append(table.text())

    def text(self) -> str:
        while self.tables:
            self._end_table()
        self._flush()
        out, last = [], ""
        for block in self.blocks:
            # Items of one list follow each other without a blank line.
            tight = re.match(r" *(- |\d+\. )", block) and re.match(r" *(- |\d+\. )", last)
            out += ["\n" if tight else "\n\n", block]
            last = block
        return "".join(out[1:])
