def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text))
