"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Texts are read in overlapping windows of twice a template's size (by size classes), so wherever a licence stands
in a document, one window holds all of it; the band settings make this window meet the template's bands with probability
0.999 or more, and what is met counts if the document has at least ``THRESHOLD`` of the template's distinct
shingles of ``SHINGLE`` words. See ``containment`` for the search itself.

Cases: null ids, null texts and wordless texts match nothing. Repeated rows give a match once. With no templates
nothing matches; templates that are null or wordless match nothing. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .containment import contained

SHINGLE, THRESHOLD = 3, 0.75

#: (template id, licence, text): notices and grants as they stand in files and pages.
TEMPLATES: list[tuple[int, str, str]] = [
    (1, "MIT", "Released under the MIT License."),
    (2, "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    (3, "MIT", "Licensed under the MIT License."),
    (4, "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (5, "Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    (6, "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (7, "GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    (8, "LGPL", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    (9, "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (10, "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (11, "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (12, "CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    (13, "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (14, "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (15, "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    (16, "CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (17, "proprietary", "All rights reserved. No part of this publication may be reproduced or transmitted in any form or by any means without prior written permission"),
    (18, "proprietary", "All rights reserved."),
]


def template_table(spark, templates: list[tuple[int, str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(TEMPLATES if templates is None else templates, "item_id long, license string, text string")


def licenses(
    docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
    k: int = SHINGLE, threshold: float = THRESHOLD, **options,
) -> DataFrame:
    """(doc_id, template_id, license, containment) for every template that a document holds."""
    templates = template_table(docs.sparkSession) if templates is None else templates
    found = contained(docs, templates, k, threshold, id_col=id_col, text_col=text_col, **options)
    names = templates.select("item_id", "license").groupBy("item_id").agg(F.min("license").alias("license"))
    return found.join(names, "item_id").select("doc_id", F.col("item_id").alias("template_id"), "license", "containment")


def oracle_sql() -> str:
    rows = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, name, text in TEMPLATES)
    words = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    k = SHINGLE - 1
    return f"""
WITH t(id, license, text) AS (VALUES {rows}),
w AS (SELECT 'd' AS kind, doc_id AS id, {words} AS ws FROM documents UNION ALL SELECT 't', id, {words} FROM t),
s AS (SELECT DISTINCT kind, id, unnest([array_to_string(ws[i:i+{k}], ' ') for i in range(1, len(ws) - {k - 1})]) AS g FROM w),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 't' GROUP BY 1),
m AS (SELECT d.id AS doc_id, b.id, count(*) AS c FROM s b JOIN s d ON d.g = b.g AND d.kind = 'd' WHERE b.kind = 't' GROUP BY 1, 2)
SELECT doc_id, m.id::BIGINT AS template_id, license, c::DOUBLE / n AS containment
FROM m JOIN n ON m.id = n.id JOIN t ON t.id = m.id WHERE c::DOUBLE / n >= {THRESHOLD}
"""
