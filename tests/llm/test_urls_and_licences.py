"""URL rules and licences against brute force and on odd rows."""

import random
import re
from importlib.metadata import distribution

from strataframe.llm import licences, url_filter
from tests.llm.conftest import rows_of


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)}))
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, key string, rule string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    return rows_of(url_filter.judge_urls(pages, table), "page_id", "host", "path", "rule", "verdict")


def test_nested_rules_equal_brute_force(spark):
    random.seed(4)
    labels = ["com", "net", "a", "ab", "b", "www", "a-b"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/f?q", "/e"]
    host = lambda: ".".join(random.choice(labels) for _ in range(random.randint(1, 4)))
    urls = [f"http://{host()}{random.choice(paths)}" for _ in range(600)]
    urls += [None, "", "no scheme", "http://", "https:///path", "ftp://A.CoM/En/", "x://a.com:80/en/", "x://a.com.", "http://a://b.com/"]
    urls += ["http://hot.com/en/x"] * 400
    rules = sorted({(host(), random.choice(paths[:5])): random.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    assert judged(spark, urls, rules) == sorted(((i, *brute(u, rules)) for i, u in enumerate(urls)), key=repr)


def test_rules_with_gaps_and_equal_rules(spark):
    rules = [("COM", "/", "allow"), ("com", "/", "block"), (None, "/", "block"), ("", "/", "block"), ("net", None, "block")]
    assert judged(spark, ["http://x.com/a", "http://y.net", "http://z.org/"], rules) == [
        (0, "x.com", "/a", "com/", "block"), (1, "y.net", "", "net", "block"), (2, "z.org", "/", None, "allow")
    ]


def test_no_pages_and_no_rules(spark):
    assert judged(spark, [], [("com", "/", "block")]) == []
    assert judged(spark, ["http://a.com/"], []) == [(0, "a.com", "/", None, "allow")]


FILES = [
    (1, "lib/LICENSE", "Released under the MIT License."),
    (2, "lib/core/deep/a.txt", "plain text"),
    (3, "lib/core/COPYING.md", "Licensed under the Apache License, Version 2.0."),
    (4, "lib/core/deep/b.txt", "words\nReleased under the MIT License. More words."),
    (5, "lib/c.txt", None),
    (6, "other/d.txt", ""),
    (7, None, "Licensed under CC BY-NC 4.0."),
    (8, "top.txt", "the word license alone"),
    (9, "lib2/LICENSE", "nothing of the kind"),
    (9, "lib2/LICENSE", "nothing of the kind"),
    (None, "lib/core/e.txt", "x"),
    (10, "lib/core/LICENSED.txt", "All rights reserved. " + "w " * 50_000),
]


def test_licences_and_inheritance(spark):
    files = spark.createDataFrame([(*f, "x", "y") for f in FILES], "doc_id long, path string, text string, licence string, word string")
    got = rows_of(licences.licence_scan(files), "doc_id", "licence", "origin")
    assert got == sorted(
        [
            (1, "MIT", "own"), (2, "Apache-2.0", "inherited"), (3, "Apache-2.0", "own"), (4, "MIT", "own"), (5, "MIT", "inherited"),
            (6, None, "none"), (7, "CC-BY-NC-4.0", "own"), (8, None, "none"), (9, None, "none"), (9, None, "none"),
            (None, "Apache-2.0", "inherited"), (10, "Proprietary", "own"),
        ],
        key=repr,
    )


def test_templates_match_themselves_only(spark):
    rows = [(i, f"p/{i}", notice) for i, (_, notice) in enumerate(licences.TEMPLATES)]
    got = rows_of(licences.licence_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")), "doc_id", "licence", "cosine")
    assert got == sorted(((i, name, 1.0) for i, (name, _) in enumerate(licences.TEMPLATES)), key=repr)


APACHE = """Copyright 2020 Somebody Else

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
CODE = "\nimport os\nfor name in os.listdir():\n    print(name)\n" * 50


def marked(header, marker):
    return "\n".join(f"{marker} {line}".rstrip() for line in header.split("\n"))


def test_whole_licence_files_and_wrapped_headers(spark):
    texts = {n: t for n, t in licences.all_templates()[-len(licences.TEXTS):]}
    mine = "Copyright (c) 2021, Some Body\nAll rights reserved.\n\n"
    files = [(i, f"whole{i}/LICENSE", mine + texts[n], n, "own") for i, n in enumerate(licences.TEXTS)]
    files += [(100 + i, f"whole{i}/sub/code.py", CODE, n, "inherited") for i, n in enumerate(licences.TEXTS)]
    real = next(f for f in distribution("pytest").files if f.name == "LICENSE")
    headers = [
        ("MIT", distribution("pytest").locate_file(real).read_text()),
        ("Apache-2.0", marked(APACHE, "#") + CODE), ("Apache-2.0", "/*\n" + marked(APACHE, " *") + "\n */" + CODE), ("Apache-2.0", APACHE + "\n\n" + CODE),
        ("GPL-3.0", marked(GPL, "//") + CODE), ("GPL-2.0", marked(GPL.replace("version 3", "version 2"), "//") + CODE),
        ("AGPL-3.0", marked(GPL.replace("GNU", "GNU Affero"), "--") + CODE),
        ("MIT", marked(mine + texts["MIT"], "#") + CODE), ("BSD-2-Clause", marked(mine + texts["BSD-2-Clause"], "#") + CODE),
        ("BSD-3-Clause", mine + texts["BSD-3-Clause"] + "\n" + CODE), ("CC-BY-SA-4.0", "# This work is licensed under a Creative Commons\n"
         "# Attribution-ShareAlike 4.0 International License." + CODE), ("MIT", "# Released under\n# the MIT License." + CODE),
        (None, CODE), ("Proprietary", "# Copyright 2020\n# All rights reserved.\n" + CODE),
    ]
    files += [(200 + i, f"headers/{i}.c", text, name, "own" if name else "none") for i, (name, text) in enumerate(headers)]
    got = rows_of(licences.licence_scan(spark.createDataFrame([f[:3] for f in files], "doc_id long, path string, text string")), "doc_id", "licence", "origin")
    assert got == sorted(((i, n, o) for i, _, _, n, o in files), key=repr)


def test_every_template_has_wording():
    assert all(re.search(licences.WORDING, notice) for _, notice in licences.all_templates())
    headers = [notice for name, notice in licences.all_templates() if name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause")]
    for parts in (notice.strip().split("\n\n") for notice in headers):
        assert len(parts) < licences.BLOCK and re.search(licences.WORDING, parts[0]) and re.search(licences.WORDING, parts[-1])


def test_no_files(spark):
    assert licences.licence_scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0
