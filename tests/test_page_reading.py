"""Pages are read in time and memory that grow as they do."""

import gc

from datebook.operators.html import Node, drop_noise, read_page


def test_pages_leave_no_cycles():
    gc.collect()
    gc.disable()
    try:
        read_page("<div class=nav><p>a</div><main><h1>b</h1></main>")
        assert not [x for x in gc.get_objects() if isinstance(x, Node)]
    finally:
        gc.enable()


def test_noise_in_noise(monkeypatch):
    walks, walk = [], Node.descendants
    monkeypatch.setattr(Node, "descendants", lambda self: walks.append(1) or walk(self))
    root = node = Node("body", {})
    for _ in range(300):
        node = Node("div", {"class": "nav"}, node)
    Node("h1", {}, node).children.append("kept")
    drop_noise(root)
    assert root.text() == "kept" and len(walks) == 1
