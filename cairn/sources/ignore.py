"""Ignore files as git reads them, over a list of paths."""

from __future__ import annotations

import re


def glob_pattern(glob: str) -> str:
    """A regular expression for a path pattern: `*` and `?` stay within a name, `**` crosses directories."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif glob[k] == "[" and (end := glob.find("]", k + 2)) > 0:
            inner = glob[k + 1 : end].replace("\\", "\\\\")
            out, k = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", end + 1
        else:
            letter = glob[k + 1] if glob[k] == "\\" and k + 1 < len(glob) else None
            out += re.escape(letter) if letter else {"*": "[^/]*", "?": "[^/]"}.get(glob[k], re.escape(glob[k]))
            k += 2 if letter else 1
    return out


def rules_of(text: str) -> list[tuple[re.Pattern, bool, bool]]:
    """(pattern of the path below the file's directory, whether it takes back, whether it fits directories only), in order."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        line = line[1:] if back else line
        folder, body = line.endswith("/"), line.strip("/")
        if body:
            anchored = "/" in line.rstrip("/")
            out.append((re.compile(("" if anchored else "(?:.*/)?") + glob_pattern(body) + r"\Z"), back, folder))
    return out


def kept(paths: list[str], texts: dict[str, str]) -> list[str]:
    """The paths that no ignore file leaves out; texts: directory (empty: the top) to the text of its ignore file.

    The last rule that fits wins, deeper files after upper ones; nothing below an ignored directory comes back.
    """
    rules, known = {d: rules_of(t) for d, t in texts.items()}, {"": False}

    def gone(path: str, is_folder: bool) -> bool:
        if path in known:
            return known[path]
        above = path.rpartition("/")[0]
        found = gone(above, True)
        if not found:
            parts = path.split("/")
            for k in range(len(parts)):
                for pattern, back, folder in rules.get("/".join(parts[:k]), ()):
                    if (is_folder or not folder) and pattern.match("/".join(parts[k:])):
                        found = not back
        if is_folder:
            known[path] = found
        return found

    return [p for p in paths if not gone(p, False)]
