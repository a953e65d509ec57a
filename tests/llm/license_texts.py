"""Licence texts and headers as they stand in files (of ISC and Unlicense their first paragraphs): name -> (expected licence, text).  Fixed values."""

MIT = '''MIT License

Copyright (c) 2021 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
'''
BSD_HEAD = '''Copyright (c) 2020, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

'''
BSD_NAMES = '''3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

'''
BSD_TAIL = '''THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
'''
APACHE = '''Copyright 2020 Some Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
'''
GPL = '''Copyright (C) 2020  Some Body

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation, either version {version} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
'''
MPL = '''This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
'''
ISC = '''ISC License

Copyright (c) 2020, Some Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
'''
UNLICENSE = '''This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
'''
TEXTS = {
    "mit": ("MIT", MIT),
    "bsd2": ("BSD-2-Clause", BSD_HEAD + BSD_TAIL),
    "bsd3": ("BSD-3-Clause", BSD_HEAD + BSD_NAMES + BSD_TAIL),
    "apache": ("Apache-2.0", APACHE),
    "gpl3": ("GPL-3.0-or-later", GPL.format(kind="", version="3")),
    "gpl2": ("GPL-2.0-or-later", GPL.format(kind="", version="2").replace("software:", "software;").replace("Foundation,", "Foundation;")),
    "agpl3": ("AGPL-3.0-or-later", GPL.format(kind="Affero ", version="3")),
    "lgpl3": ("LGPL-3.0-or-later", GPL.format(kind="Lesser ", version="3")),
    "mpl": ("MPL-2.0", MPL),
    "isc": ("ISC", ISC),
    "unlicense": ("Unlicense", UNLICENSE),
}


def in_comments(text: str, mark: str) -> str:
    return "".join(f"{mark} {line}".rstrip() + "\n" for line in text.splitlines())


def forms(text: str) -> list[str]:
    """As it stands, with Windows line ends, on one line a paragraph, in several kinds of comments, and between other text."""
    block = "/*\n" + in_comments(text, " *") + " */\nint main(void);\n"
    flat = "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))
    return [text, text.replace("\n", "\r\n"), flat, in_comments(text, "#"), in_comments(text, "//"), in_comments(text, "--"), block, f"Some words before\n\n{text}\nand after"]
