from beatwire.functions.text import (
    PARITY_SCRIPTS, SCRIPT_RANGES, clean_text, detect_language, extract_keywords, title_case,
)


def test_clean_text(value):
    cases = {
        None: "",
        "http://a.b/c First www.x.y mid HTTPS://z": "first mid",
        "a <b>bold</b> tag": "a bold tag",
        "a <b\n> kept": "a b kept",           # a tag does not cross a line break
        "one two three": "one two three",
        "x <a b> y": "x y",              # but it does cross U+2028
        "ಕನ್‌ನಡ": "ಕನ್ನಡ",                # the joiner is no letter
        "தமிழ் తెలుగు": "",
        "café 24x7!": "caf 24x7",
    }
    assert value(clean_text, *cases) == list(cases.values())


def test_clean_text_is_idempotent_without_links(value):
    texts = ["Plain, text  HERE", "ಹಾಸನ ನಗರ!", "  x\ty "]
    once = value(clean_text, *texts)
    assert value(clean_text, *once) == once


def test_clean_text_other_scripts(value):
    assert value(lambda c: clean_text(c, list(SCRIPT_RANGES)), "தமிழ் ok") == ["தமிழ் ok"]
    assert PARITY_SCRIPTS == ("devanagari", "kannada")


def test_keywords(value):
    got = value(extract_keywords,
                "Delhi delhi Delhi an car", "don't (stop) now—then", "!!! ?? a b",
                " ".join(f"word{i}" for i in range(15)), None)
    assert got == [["Delhi", "delhi", "car"], ["dont", "stop", "nowthen"], [],
                   [f"word{i}" for i in range(10)], []]
    assert value(lambda c: extract_keywords(c, None),
                 " ".join(f"word{i}" for i in range(15)))[0][-1] == "word14"


def test_language(value):
    got = value(detect_language,
                "police arrested two men in delhi today", "दिल्ली में", "", None,
                "दिल्ली में चुनाव और मौसम की खबर", "पुणे येथे निवडणूक आहे आणि पाऊस नाही",
                "ಹಾಸನ ನಗರ ಅಪಘಾತ ವರದಿ ಇಂದು", "one two three four five ನ",
                "ഇന്ന് കേരള വാർത്ത പുതിയ റിപ്പോർട്ട്")
    assert got == ["en", "en", "en", "en", "hi", "mr", "kn", "en", "ml"]


def test_title_case(value):
    assert value(title_case, "break-in the OTP", "a_b c") == ["Break-In The Otp", "A_B C"]


def test_indian_script_that_is_not_known(value):
    odia = "\u0b13\u0b21\u0b3c\u0b3f\u0b06 \u0b2d\u0b3e\u0b37\u0b3e " * 4
    assert value(detect_language, odia) == ["en"]
