"""License notices: names, texts, and the words that name the license. Full texts are files in licenses/."""

from __future__ import annotations

from pathlib import Path

_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation"
_WARRANTY = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {} for more details"
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
_BSD_2 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"
_MIT_END = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"
_UNLICENSE = "This is free and unencumbered software released into the public domain"

#: Sentences that name a license by the words in brackets.
_NAMED = {
    "MIT": "Released under the [MIT License]",
    "MIT-licensed": "This project is licensed under the terms of the [MIT license]",
    "Apache-2.0": "Licensed under the [Apache License, Version 2.0]",
    "GPL-3.0": "This work is licensed under the [GNU General Public License, version 3]",
    "GPL-2.0": "This work is licensed under the [GNU General Public License, version 2]",
    "LGPL-2.1": "This work is licensed under the [GNU Lesser General Public License, version 2.1]",
    "LGPL-3.0": "This work is licensed under the [GNU Lesser General Public License, version 3]",
    "AGPL-3.0": "This work is licensed under the [GNU Affero General Public License, version 3]",
    "GPL-grant": _GNU.format("[GNU General Public License]"),
    "LGPL-grant": _GNU.replace("program", "library").format("[GNU Lesser General Public License]"),
    "AGPL-grant": _GNU.format("[GNU Affero General Public License]"),
    "GPL-warranty": "This program " + _WARRANTY.format("[GNU General Public License]"),
    "LGPL-warranty": "This library " + _WARRANTY.format("[GNU Lesser General Public License]"),
    "AGPL-warranty": "This program " + _WARRANTY.format("[GNU Affero General Public License]"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the [Mozilla Public License, v. 2.0]",
    "EPL-1.0": "made available under the terms of the [Eclipse Public License v1.0]",
    "EPL-2.0": "made available under the terms of the [Eclipse Public License 2.0]",
    "EPL-2.0-v": "made available under the terms of the [Eclipse Public License v2.0]",
    "BSD": "Use of this source code is governed by a [BSD-style license]",
    "BSD-2-Clause": "Licensed under the [BSD 2-Clause License]",
    "BSD-3-Clause": "Licensed under the [BSD 3-Clause License]",
    "ISC": "Licensed under the [ISC License]",
    "BSL-1.0": "Distributed under the [Boost Software License, Version 1.0]",
    "Unlicense": "Released into the public domain under [the Unlicense]",
    "CC0-1.0": "Licensed under [CC0 1.0] Universal",
    **{f"CC-BY{x}-{v}": f"Licensed under [CC BY{x} {v}]" for x in ("", "-SA", "-NC", "-ND", "-NC-SA", "-NC-ND") for v in ("3.0", "4.0")},
    **{f"CC-BY{x}-{v}-long": f"This work is licensed under a [Creative Commons Attribution{words} {v}] {port} License" for x, words in {"": "", "-SA": "-ShareAlike", "-NC": "-NonCommercial", "-ND": "-NoDerivatives", "-NC-SA": "-NonCommercial-ShareAlike", "-NC-ND": "-NonCommercial-NoDerivatives"}.items() for v, port in (("3.0", "Unported"), ("4.0", "International"))},
}

#: Notices as they stand in public files.
TEMPLATES = {
    **{name: text.replace("[", "").replace("]", "") for name, text in _NAMED.items()},
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT-disclaimer": _MIT_END,
    "Apache-2.0-terms": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MPL-2.0-terms": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "BSD-terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-conditions": _BSD_2,
    "BSD-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BSD-disclaimer": _BSD_END,
    "ISC-grant": _ISC + ", provided that the above copyright notice and this permission notice appear in all copies",
    "ISC-or-0BSD-grant": _ISC,
    "ISC-disclaimer": _ISC_END,
    "Zlib-terms": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "Unlicense-grant": _UNLICENSE,
    "Unlicense-text": _UNLICENSE + ". Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "CC0-1.0-waiver": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "EPL-1.0-header": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "reserved": "All rights reserved",
    **{f"{p.stem}-text": p.read_text("utf-8", "replace") for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))},
}
#: By name: what stands before the words that name the license, those words, and what stands behind.
PARTS = {name: text.replace("]", "[").split("[") for name, text in _NAMED.items()}
