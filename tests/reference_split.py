"""A character-by-character reader of packed fields, to test the operator against."""

MARKS = ",;|/" + chr(0xFF0C) + chr(0x3001)
PAIRS = {"[": "]", "(": ")", "{": "}"}


def split(text):
    """[(pos, item)] of a field, by a plain state machine."""
    if text is None:
        return []
    text = text.strip()
    if not text:
        return []

    def scan(s):
        """Tokens: ('q', value) for quoted spans, ('c', char) for others."""
        out, i = [], 0
        while i < len(s):
            ch = s[i]
            begin = i == 0 or s[i - 1] in MARKS or s[i - 1] in "[({" or s[i - 1].isspace()
            if ch in "\"'" and begin:
                j, value = i + 1, []
                while j < len(s):
                    if s[j] == ch:
                        if s[j + 1 : j + 2] == ch:
                            value.append(ch)
                            j += 2
                            continue
                        nxt = s[j + 1 : j + 2]
                        if nxt == "" or nxt in MARKS or nxt in "])}" or nxt.isspace():
                            break
                    value.append(s[j])
                    j += 1
                if j < len(s):
                    out.append(("q", "".join(value)))
                    i = j + 1
                    continue
            out.append(("c", ch))
            i += 1
        return out

    tokens = scan(text)
    is_blank = lambda t: t[0] == "c" and t[1].isspace()

    def wrapped(ts):
        """Whether the first bracket's partner is the last character."""
        if len(ts) < 2 or ts[0][0] != "c" or ts[0][1] not in PAIRS or ts[-1] != ("c", PAIRS[ts[0][1]]):
            return False
        depth = 0
        for i, t in enumerate(ts):
            depth += (t == ts[0]) - (t == ts[-1])
            if depth == 0:
                return i == len(ts) - 1
        return False

    while wrapped(tokens):
        tokens = tokens[1:-1]
        while tokens and is_blank(tokens[0]):
            tokens = tokens[1:]
        while tokens and is_blank(tokens[-1]):
            tokens = tokens[:-1]
    places, current, i = [], [], 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and is_blank(tokens[j]):
            j += 1
        if j < len(tokens) and tokens[j][0] == "c" and tokens[j][1] in MARKS:
            j += 1
            while j < len(tokens) and is_blank(tokens[j]):
                j += 1
        elif j == i:
            current.append(tokens[i][1])
            i += 1
            continue
        places.append("".join(current))
        current, i = [], j
    places.append("".join(current))
    return [(k, p.strip()) for k, p in enumerate(places, 1) if p.strip()]
