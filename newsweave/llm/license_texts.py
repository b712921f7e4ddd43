"""Licence sentences in their published wording, and the rules that name licences by them."""

from __future__ import annotations

# Licence sentences by identifier, in their published wording.
SENTENCES = {
    "mit-line": "Released under the MIT License.",
    "mit-lic": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zero-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "bsd3-line": "Licensed under the BSD 3-Clause License.",
    "bsd2-line": "Licensed under the BSD 2-Clause License.",
    "bsd-redist": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-copy-https": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl2-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl2-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc0-line": "Licensed under CC0 1.0.",
    "cc0-deed": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    "cc0-free": "You can copy, modify, distribute and perform the work, even for commercial purposes, all without asking permission.",
    "ccby-line": "Licensed under CC BY 4.0.",
    "ccbysa-line": "Licensed under CC BY-SA 4.0.",
    "ccbync-line": "Licensed under CC BY-NC 4.0.",
    "ccbyncsa-line": "Licensed under CC BY-NC-SA 4.0.",
    "ccbynd-line": "Licensed under CC BY-ND 4.0.",
    "ccbyncnd-line": "Licensed under CC BY-NC-ND 4.0.",
    "ccby-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbysa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ccbync-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "ccbyncsa-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "ccbynd-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "ccbyncnd-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "unlicense-any": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-line": "Distributed under the Boost Software License, Version 1.0.",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "epl2-line": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "lgpl20-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gfdl13-free": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
    "wtfpl-copy": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
}
# Rules, each a licence and a sequence of sentence identifiers.
RULES = (
    ("MIT", ("mit-line",)),
    ("MIT", ("mit-lic",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-and",)),
    ("0BSD", ("zero-grant", "isc-warranty")),
    ("BSD-2-Clause", ("bsd2-line",)),
    ("BSD-2-Clause", ("bsd-redist", "bsd-source")),
    ("BSD-3-Clause", ("bsd3-line",)),
    ("BSD-3-Clause", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-name")),
    ("Apache-2.0", ("apache-line",)),
    ("Apache-2.0", ("apache-grant", "apache-copy")),
    ("Apache-2.0", ("apache-grant", "apache-basis")),
    ("MPL-2.0", ("mpl-form", "mpl-copy")),
    ("MPL-2.0", ("mpl-form", "mpl-copy-https")),
    ("GPL-2.0-only", ("gpl2-only", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("GPL-3.0-only", ("gpl3-line",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("LGPL-2.1-or-later", ("lgpl2-free", "lgpl2-hope")),
    ("LGPL-3.0-or-later", ("lgpl3-free", "gpl-hope")),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope")),
    ("CC0-1.0", ("cc0-line",)),
    ("CC0-1.0", ("cc0-deed", "cc0-free")),
    ("CC-BY-4.0", ("ccby-line",)),
    ("CC-BY-4.0", ("ccby-work",)),
    ("CC-BY-SA-4.0", ("ccbysa-line",)),
    ("CC-BY-SA-4.0", ("ccbysa-work",)),
    ("CC-BY-NC-4.0", ("ccbync-line",)),
    ("CC-BY-NC-4.0", ("ccbync-work",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa-line",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa-work",)),
    ("CC-BY-ND-4.0", ("ccbynd-line",)),
    ("CC-BY-ND-4.0", ("ccbynd-work",)),
    ("CC-BY-NC-ND-4.0", ("ccbyncnd-line",)),
    ("CC-BY-NC-ND-4.0", ("ccbyncnd-work",)),
    ("Unlicense", ("unlicense-free", "unlicense-any")),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("BSL-1.0", ("boost-line",)),
    ("BSL-1.0", ("boost-grant",)),
    ("EPL-2.0", ("epl2-line",)),
    ("LGPL-2.0-or-later", ("lgpl20-free", "lgpl2-hope")),
    ("GFDL-1.3-or-later", ("gfdl13-free",)),
    ("WTFPL", ("wtfpl-copy",)),
)
# A licence whose sentences all stand in another one's text too.
PART_OF = {"BSD-2-Clause": "BSD-3-Clause"}

# A licence can also be named by its identifier line.
LICENCES = (*dict.fromkeys(name for name, _ in RULES), "Artistic-2.0", "PSF-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")
SENTENCES |= {f"spdx-{name.lower()}": f"SPDX-License-Identifier: {name}" for name in LICENCES}
RULES += tuple((name, (f"spdx-{name.lower()}",)) for name in LICENCES)
