#: NULL, empty, blank, repeated, very long, non-Latin, not normalised and control characters.
ODD = [None, "", " ", "\n\n", "same text here.", "same text here.", "word " * 40_000, "x" * 30_000, "日本語のテキスト。次の文。", "é    é 😀😀 a1b2", "\x00\x01\ttab\r\nline", "'s 're don't I'LL 12345678901234567890"]
