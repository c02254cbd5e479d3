import re

#: Names that operators might use for columns of their own, and one that must be quoted.
CLASH = ("size", "g", "fp", "mark", "epochs", "_bucket", "_key", "_doc", "_n", "score", "lang_pred", "rejected", "n_lines", "n_dropped", "start", "length", "hash", "__key", "_hash", "_same", "_none", "_lines", "row", "order", "times", "copy", "a.b")


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
