"""Notices as they are published: wrapped, and on a line with other text."""

import textwrap

from reelspan.llm.licenses import MAY_DIFFER, NOTICES, Scanner, word_differences, wording

S = Scanner(NOTICES)


def test_wrapped_notices():
    for k, (name, text) in enumerate(NOTICES):
        for width in (60, 80):
            lines = textwrap.wrap(text, width, break_on_hyphens=False)
            assert [(f[0], f[1], f[2], f[5]) for f in S.scan("Some title\n\n" + "\n".join(lines) + "\n\nmore")] == [(2, len(lines), name, 0)], k


def test_inline_notices():
    got = S.scan("Some prose before it. Licensed under the Apache License, Version 2.0.")
    assert [(f[0], f[1], f[2], f[5]) for f in got] == [(0, 1, "Apache-2.0", 0)]
    got = S.scan("Released under the MIT License. See the file for what that means to you.\nNothing here.")
    assert [(f[0], f[1], f[2], f[5]) for f in got] == [(0, 1, "MIT", 0)]
    assert S.scan("It was a license to do nothing in particular, and nobody had asked for a copy of it.\nThat was all.") == []


def test_no_near_notice_is_left_out():
    known = [wording(text) for _, text in NOTICES]
    for notice in known:
        for k in range(len(notice)):
            for put in ([], ["changed"]):
                words = wording(" ".join(notice[:k] + put + notice[k + 1 :]))
                near = [d for n in known if (d := word_differences(words, n)) <= MAY_DIFFER * len(n)]
                got = S.judge(" ".join(words))
                assert (got and got[3]) == min(near, default=None), words
