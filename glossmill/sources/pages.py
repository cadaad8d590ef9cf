"""Text runs and form signals of HTML pages, in one pass of Arrow batches over `pages`."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Tags whose text is left out, and tags that break a line.
FILTERED = set("script style noscript textarea input select option template pre code kbd samp button svg math nav".split())
BLOCKS = set("address article aside blockquote dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Form attributes that mark a page as sensitive.
AUTOCOMPLETE = {
    "current-password": "PASSWORD_AUTOCOMPLETE", "new-password": "PASSWORD_AUTOCOMPLETE", "one-time-code": "ONE_TIME_CODE_AUTOCOMPLETE",
    "cc-number": "PAYMENT_AUTOCOMPLETE", "cc-csc": "PAYMENT_AUTOCOMPLETE", "cc-exp": "PAYMENT_AUTOCOMPLETE", "cc-exp-month": "PAYMENT_AUTOCOMPLETE", "cc-exp-year": "PAYMENT_AUTOCOMPLETE",
}
NAMES = set("access-token api-key card-number client-secret credit-card csc cvc cvv one-time-code otp passcode password private-key security-code".split())
PRESENCE = ("data-private", "data-sensitive", "data-1p-ignore", "data-bwignore")
MOST_ELEMENTS = 128


def hidden(tag: str, attrs: dict) -> bool:
    """Whether an element's text is left out by its tag or attributes."""
    style = re.sub(r"\s+", "", attrs.get("style") or "").lower()
    role = (attrs.get("role") or "").strip().lower()
    editable = "contenteditable" in attrs and (attrs["contenteditable"] or "true").lower() != "false"
    return tag in FILTERED or role in ("navigation", "textbox") or "hidden" in attrs or "inert" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or editable or "display:none" in style or "visibility:hidden" in style or (attrs.get("data-sensitive") or "").lower() == "true" or (attrs.get("data-private") or "").lower() == "true"


class Page(HTMLParser):
    """Collects visible text nodes, line breaks before them, and form signals."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.off, self.runs, self.broken, self.node = [], 0, [], False, 0
        self.signals, self.checked, self.failure = set(), 0, None

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        self._inspect(tag, found)
        if tag in BLOCKS or tag == "br":
            self.broken = True
        if tag not in VOID:
            out = hidden(tag, found)
            self.stack.append((tag, out))
            self.off += out

    def handle_startendtag(self, tag, attrs):
        self._inspect(tag, dict(attrs))
        self.broken = self.broken or tag in BLOCKS or tag == "br"

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.broken = True
        if any(t == tag for t, _ in self.stack):
            while self.stack:
                top, out = self.stack.pop()
                self.off -= out
                if top == tag:
                    return

    def handle_data(self, data):
        self.node += 1
        if self.off or not data.strip():
            return
        self.runs.append((f"n{self.node}", data, "\n" if self.broken and self.runs else ""))
        self.broken = False

    def _inspect(self, tag, attrs):
        if tag not in ("input", "select", "textarea", "form") and "role" not in attrs and not any(p in attrs for p in PRESENCE):
            return
        self.checked += 1
        if self.checked > MOST_ELEMENTS:
            self.failure = self.failure or "DOM_SCAN_BUDGET_EXCEEDED"
        values = {k: (attrs.get(k) or "") for k in ("type", "autocomplete", "name", "role")}
        if any(len(v) > 128 or re.search(r"[\x00-\x1f\x7f]", v) for v in values.values()):
            self.failure = "DOM_SCAN_ERROR"
            return
        values = {k: v.strip().lower() for k, v in values.items()}
        if tag == "input" and values["type"] == "hidden":
            return
        if tag == "input" and values["type"] == "password":
            self.signals.add("PASSWORD_TYPE")
        self.signals |= {AUTOCOMPLETE[t] for t in values["autocomplete"].split() if t in AUTOCOMPLETE}
        if "-".join(filter(None, re.split("[^a-z0-9]+", values["name"]))) in NAMES:
            self.signals.add("SENSITIVE_NAME")
        if any(p in attrs for p in PRESENCE):
            self.signals.add("PRIVATE_PRESENCE")


_REFERENCE = re.compile("&(?:#[0-9]+;|#[xX][0-9a-fA-F]+;|([A-Za-z][A-Za-z0-9]*;))?")


def closed(html: str) -> str:
    """html with each ampersand escaped that begins no whole reference, one that a semicolon ends."""
    return _REFERENCE.sub(lambda m: "&amp;" + m[0][1:] if m[0] == "&" or m[1] and m[1] not in html5 else m[0], html)


def parse(html: str | None, bare: bool = True) -> Page:
    """The page as parsed; with bare, references without a semicolon (&amp, &copy) are decoded like others, as HTML does."""
    page = Page()
    page.feed((html or "") if bare else closed(html or ""))
    page.close()
    return page


def text_runs(pages: DataFrame, bare: bool = True) -> DataFrame:
    """page_id, run_ix, node_id, text, start, end, boundary_before for pages(page_id, html).

    Without bare, references that no semicolon ends, as where a title was cut within one, stay as they are written.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for page_id, html in zip(pdf["page_id"], pdf["html"]):
                at = 0
                for ix, (node, text, boundary) in enumerate(parse(html, bare).runs):
                    at += len(boundary)
                    out.append((page_id, ix, node, text, at, at + len(text), boundary))
                    at += len(text)
            yield pd.DataFrame(out, columns=["page_id", "run_ix", "node_id", "text", "start", "end", "boundary_before"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, run_ix int, node_id string, text string, start int, end int, boundary_before string")


def form_signals(pages: DataFrame) -> DataFrame:
    """page_id, url, signals, scan_failure for pages(page_id, url, html)."""

    def run(batches):
        for pdf in batches:
            found = [parse(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "signals": [sorted(p.signals) for p in found], "scan_failure": [p.failure for p in found]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, signals array<string>, scan_failure string")


def page_texts(runs: DataFrame) -> DataFrame:
    """page_id, text: runs of a page joined with their boundaries, to cut into sentences."""
    from pyspark.sql import functions as F

    piece = F.struct("run_ix", F.concat("boundary_before", "text").alias("t"))
    return runs.groupBy("page_id").agg(F.sort_array(F.collect_list(piece)).alias("p")).select("page_id", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"))
