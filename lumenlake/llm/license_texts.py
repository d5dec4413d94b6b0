"""Whole texts of short licences and usual one-line notices, as published."""

# Licence id -> texts that stand for it.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_PERMISSION = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
_ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
KNOWN: dict[str, tuple[str, ...]] = {
    "0BSD": (f"BSD Zero Clause License\n\n{_PERMISSION}.\n\n{_ISC_AS_IS}", f"{_PERMISSION}.\n\n{_ISC_AS_IS}"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License.",
    ),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "GPL-2.0-only": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0-only": ("This work is licensed under the GNU General Public License, version 3.",
                     "Licensed under the GNU General Public License, version 3."),
    "ISC": (f"ISC License\n\n{_PERMISSION}, provided that the above copyright notice and this permission notice appear in all "
            f"copies.\n\n{_ISC_AS_IS}",),
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT License.",
        'MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and '
        'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
        f"The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_AS_IS}",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or "
        "authors of this software dedicate any and all copyright interest in the software to the public domain. We make this "
        "dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
        "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under "
        'copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n"
        "For more information, please refer to <https://unlicense.org>",
    ),
}
# Further whole texts by (licence id, canonical digest, first word, last word): with and without the appendix after
# the terms, with the usual titles and without. The form is that of `license_scan`; a change to it needs new digests.
WHOLE: tuple[tuple[str, str, str, str], ...] = (
    ("Apache-2.0", "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a", "apache", "liability"),
    ("Apache-2.0", "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184", "apache", "license"),
    ("Apache-2.0", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0", "apache", "conditions"),
    ("BSD-2-Clause", "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2", "bsd", "damage"),
    ("BSD-2-Clause", "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30", "redistribution", "damage"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651", "redistribution", "damage"),
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2", "redistribution", "damage"),
    ("BSD-3-Clause", "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15", "bsd", "damage"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", "creative", "work"),
    ("GPL-2.0-only", "1e8914444281fb700f86e27a49e84f8ce49d6038c9df4d3558556de7a8f1fbf1", "gnu", "damages"),
    ("GPL-2.0-only", "7dcff3241eb084a5b390fe94780ca6a71766f1ba171577b393ec293c1d0971a7", "gnu", "conditions"),
    ("GPL-2.0-only", "e8bf95d131adef38fed359d8094ed9e29841c95a469b429a8219535fb1aa0c22", "gnu", "license"),
    ("GPL-3.0-only", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191", "gnu", "fee"),
    ("GPL-3.0-only", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636", "gnu", "conditions"),
    ("GPL-3.0-only", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a", "gnu", "html"),
    ("ISC", "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a", "permission", "software"),
    ("ISC", "23651ce8a73abaa8fad9143faad3fca843b5de6baf345008f65c453ea5685fb1", "isc", "software"),
    ("ISC", "40e6eb51c3b409d93549806b55b249c261dab149d19b56cc163624f39a08b1db", "the", "software"),
    ("LGPL-2.1-only", "36742c1eb66993bd1356d9d90c137bd6ae92910a0d44e0093b99e421595ce03f", "gnu", "conditions"),
    ("LGPL-2.1-only", "446c21a03ef2a7bf84827ba3f0d7010657ad875eebd282c7b0c236f1cd60c2c1", "gnu", "it"),
    ("LGPL-2.1-only", "f9036d772cb0d671bb1ac550a612a9fb60ab8d2800b9dadcff438b95ca3d64b6", "gnu", "damages"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", "gnu", "library"),
    ("MIT", "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c", "permission", "software"),
    ("MIT", "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f", "the", "software"),
    ("MIT", "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127", "the", "software"),
    ("MPL-2.0", "fed30cace846a13ba04565551e526a8de00de8f2938c37a0cfb4d9f9430d70e9", "mozilla", "0"),
)
