
from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tidewater.llm import license_scan, packing, queries, toxicity
from tidewater.llm.textkernel import chunks


def test_rare_toxic_terms_are_entries_however_many_toxic_texts(spark):
    toxic = [(f"common{i % 4}bad text {'schlimmwort' if i < 4 else ''} of {i}", 1) for i in range(1000)]
    plain = [(f"good text of {i}", 0) for i in range(9000)]
    words = {text for text, _, _ in toxicity._entries(spark.createDataFrame(toxic + plain, "text string, toxic int"))}
    assert any("schlimmwort".startswith(w) for w in words)


def test_near_misses_are_not_the_license(spark):
    expected = {
        "Released under the MIT License.": "mit-line", "Released under the BSD License.": "bsd-line", "Released under the Apache License.": None, "Licensed under CC BY 4.0.": "cc-by-4.0-line",
        "Licensed under CC BY-SA 4.0.": "cc-by-sa-4.0-line", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0-line", "Licensed under CC BY NC 4.0.": None, "Licensed under CC BY-NC 5.0.": None, "CC BY-SA 4.0.": None,
        "Licensed under the Apache License, Version 1.1.": "apache-1.1-line", "Licensed under the Apache License, Version 2": "apache-2.0-line",
        "This work is licensed under the GNU General Public License, version 2.": "gpl-2.0-line", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0-line",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "lgpl-3.0-line", "This work is licensed under the GNU General Public License, version 2. Chapter 3": "gpl-2.0-line",
        "SPDX-License-Identifier: ISC": "isc-spdx", **{text: name for name, text in license_scan.TEMPLATES.items() if not name.endswith("-line")},
        license_scan.TEMPLATES["gpl-3.0-or-later"].replace("version 3", "version 4"): None,
    }
    docs = spark.createDataFrame([(i, text) for i, text in enumerate(expected)], "doc_id int, text string")
    got = {r["doc_id"]: r["license"] for r in license_scan.scan_licenses(docs).collect()}
    assert [(t[:80], got[i]) for i, t in enumerate(expected)] == [(t[:80], name) for t, name in expected.items()]


def test_misspelled_inflections_of_a_beginning_are_hits(spark):
    toxic = [(f"you {word} of {i}", 1) for i in range(20) for word in ("grobianisch", "grobianismus")]
    lexicon = toxicity.Lexicon(toxicity._entries(spark.createDataFrame(toxic + [(f"good text of {i}", 0) for i in range(400)], "text string, toxic int")))
    whole = lexicon.exact("grobianismus")
    assert lexicon.entries[whole][1] and "grobianismus".startswith(lexicon.entries[whole][0])
    for word, meant in (("grxbianismus", "grobianismus"), ("gobianisch", "grobianisch"), ("goobianisch", "grobianisch")):
        assert lexicon.exact(word) is None and lexicon.entries[lexicon.fuzzy(word)][0] == meant


END_OF_TEXT = ["a <|endoftext|> x", "<|endoftext|>", "a<|endoftext|>b", "a  <|endoftext|>\n<|endoftext|> don't", "<|endoftext| > <|endoftext |>", "é <|endoftext|>é", "plain text"]


def test_added_tokens_are_one_id(spark):
    prescribed = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = [prescribed.encode(text, add_special_tokens=False).ids for text in END_OF_TEXT]
    assert expected[0] == [64, 220, 50256, 2124]
    for kind in ("json", "tiktoken"):
        tokens = packing.Tokens(public_tokenizers.path(f"byte_bpe_50k.{kind}"), public_tokenizers.PATTERN, queries.added_tokens())
        assert [ids.tolist() for c in chunks(pa.array(END_OF_TEXT), 30) for ids in tokens(c)] == expected


def test_packing_counts_added_tokens_once(spark, tmp_path):
    spark.createDataFrame([(1, "a <|endoftext|> x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r["doc_tokens"] for r in queries.op5_packing(spark, str(tmp_path)).collect()] == [5]
