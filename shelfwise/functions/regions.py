"""Text of the description blocks of a web page."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# HTML elements that never have an end tag.
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "param", "source", "track", "wbr",
)


def region_text(html: Column, fragment: str = "desc") -> Column:
    """Lines of every ``div`` whose class holds ``fragment``, in any case.

    Scripts and styles are dropped, lines are trimmed, blank ones skipped. A matching div inside a
    matching div gives its lines twice: once within the outer one and once on its own. Pages
    without such a div, and null pages, give an empty text.

    This is the one place that needs Python: nested blocks cannot be found with a regular
    expression. Pages stream through in Arrow batches; nothing is shuffled.
    """
    wanted = fragment.lower()
    void = frozenset(VOID_TAGS)

    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re
        from html import unescape
        from html.entities import html5
        from html.parser import HTMLParser

        # A class may be written with character references; such pages are parsed to be sure.
        encoded = re.compile(r"class\s*=[^<]*&", re.IGNORECASE)

        class Regions(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=False)
                self.open = []  # tags, from the outermost to the innermost
                self.inside = []  # (depth, text pieces) of the regions that are open
                self.found = []  # text pieces of every region, in page order
                self.run = []  # text since the last tag

            def flush(self):
                text, self.run = "".join(self.run), []
                if not text or not self.inside or self.open[-1] in ("script", "style"):
                    return
                if text.isspace() and not {"pre", "textarea"}.intersection(self.open):
                    text = "\n" if "\n" in text else " "
                for _, pieces in self.inside:
                    pieces.append(text)

            def handle_starttag(self, tag, attrs):
                self.flush()
                if tag in void:
                    return
                self.open.append(tag)
                classes = " ".join((dict(attrs).get("class") or "").split()).lower()
                if tag == "div" and classes and wanted in classes:
                    self.inside.append((len(self.open), []))
                    self.found.append(self.inside[-1][1])

            def handle_startendtag(self, tag, attrs):
                self.handle_starttag(tag, attrs)
                self.handle_endtag(tag)

            def handle_endtag(self, tag):
                self.flush()
                if tag not in self.open:
                    return
                while self.open.pop() != tag:
                    pass
                while self.inside and self.inside[-1][0] > len(self.open):
                    self.inside.pop()

            def handle_comment(self, data):
                self.flush()

            def handle_decl(self, decl):
                self.flush()

            def text(self, piece):
                if self.inside:
                    self.run.append(piece)

            def handle_data(self, data):
                self.text(data)

            def handle_entityref(self, name):
                self.text(html5.get(name + ";", "&" + name))

            def handle_charref(self, name):
                self.text(unescape(f"&#{name};"))

        def lines_of(page):
            if not page or (wanted not in page.lower() and not encoded.search(page)):
                return ""
            parser = Regions()
            parser.feed(page)
            parser.close()
            parser.flush()
            lines = (
                line.strip()
                for pieces in parser.found
                for line in "".join(pieces).split("\n")
            )
            return "\n".join(line for line in lines if line)

        for pages in batches:
            yield pages.map(lines_of, na_action=None).astype("object")

    return F.pandas_udf(extract, "string")(html)
