"""Letters that only look like other letters."""

# Letters of other scripts, and variants, next to the Latin letter each looks like.
LATIN_LOOKS = dict(
    zip(
        "аеорсухіјѕһԁԛԝӏкАВЕЅЗКМНОРСТУХІЈԌ" + "οναιρυχκγόίΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ" + "օսոհցԼՕՍ" + "ɑıɡʏɪɩꞵᴏᴠᴡᴢᴜ",
        "aeopcyxijshdqwlkABES3KMHOPCTYXIJG" + "ovaipuxkyóíABEZHIKMNOPTYXcj" + "ounhgLOU" + "aigyiiBovwzu",
        strict=True,
    )
)
# Latin letters next to the Cyrillic letter each looks like.
CYRILLIC_LOOKS = dict(zip("aeopcyxijsABEKMHOPCTYXIJSk", "аеорсухіјѕАВЕКМНОРСТУХІЈЅк", strict=True))


def skeleton(word: str) -> str:
    """The word with every look-alike replaced by the Latin letter it looks like."""
    return "".join(LATIN_LOOKS.get(c, c) for c in word)


def cyrillic_skeleton(word: str) -> str:
    """The word with every Latin look-alike replaced by the Cyrillic letter it looks like."""
    return "".join(CYRILLIC_LOOKS.get(c, c) for c in word)
