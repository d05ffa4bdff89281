"""Pages read by the standard library's HTML tokenizer, to compare with."""

from html.parser import HTMLParser
from urllib.parse import urljoin


class PageReader(HTMLParser):
    hidden = ("script", "style", "template")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.pending, self.nodes = 0, "", []
        self.title, self.title_open, self.hrefs = None, False, []

    def end_node(self) -> None:
        node, self.pending = self.pending.strip(), ""
        if self.title_open and self.title is None:
            self.title = node
        if node and not self.depth:
            self.nodes.append(node)

    def handle_starttag(self, tag, attrs):
        self.end_node()
        self.depth += tag in self.hidden
        self.title_open = self.title_open or (tag == "title" and self.title is None)
        href = dict(attrs).get("href") if tag == "a" else None
        if href:
            self.hrefs.append(href)

    def handle_endtag(self, tag):
        self.end_node()
        self.depth -= tag in self.hidden and self.depth > 0
        self.title_open = self.title_open and tag != "title"

    def handle_comment(self, data):
        self.end_node()

    handle_decl = handle_pi = handle_comment

    def handle_data(self, data):
        self.pending += data


def read_page(html: str, base_url: str | None) -> tuple[str, str, list[str]]:
    """Title, text and distinct links."""
    reader = PageReader()
    reader.feed(html)
    reader.close()
    reader.end_node()
    links = {}
    for href in reader.hrefs:
        if href.startswith(("http://", "https://")):
            links[href] = None
        elif base_url:
            links[urljoin(base_url, href)] = None
    return reader.title or "", " ".join(reader.nodes), list(links)
