"""The dataset's master file: working folder, meshes, four families of variables and the time axis."""

from __future__ import annotations

import glob
import os
from dataclasses import dataclass, field

#: Sections of the master file, in order; the middle four are families of variables.
SECTIONS = ("WRKDIR", "MESH", "AVE_PHYS", "AVE_FREQ", "FORCINGS", "GENERALS", "TIME")
FAMILIES = SECTIONS[2:6]
#: The velocity is three variables of one file.
VECTOR_MARK = ","


@dataclass
class Catalog:
    workdir: str = "."
    meshes: list[tuple[str, str, str]] = field(default_factory=list)
    variables: dict[str, dict[str, tuple[str, str]]] = field(default_factory=lambda: {f: {} for f in FAMILIES})
    times: list[str] = field(default_factory=list)

    def find(self, name: str) -> tuple[str, str]:
        """(name in the file, path with *) of a variable."""
        for family in self.variables.values():
            if name in family:
                return family[name]
        raise KeyError(f"no variable {name} in the master file")

    def names(self) -> list[str]:
        return [n for family in self.variables.values() for n in family]

    def path(self, name: str, time: str) -> str:
        return os.path.join(self.workdir, self.find(name)[1].replace("*", time, 1))

    def mesh(self, projection: str | None = None) -> tuple[str, str]:
        """(mesh file, meshmask file) of a projection, the first without one."""
        for name, mesh, mask in self.meshes:
            if projection is None or name.lower() == projection.lower():
                return os.path.join(self.workdir, mesh), os.path.join(self.workdir, mask)
        raise KeyError(f"no mesh for projection {projection}")


def parse(text: str) -> Catalog:
    """A master file's text; # starts a comment line; each list begins with its length."""
    lines = [x.strip() for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    catalog, section, left = Catalog(), None, None
    for line in lines:
        if line in SECTIONS:
            section, left = line, None
            continue
        if section == "WRKDIR":
            catalog.workdir = line
        elif left is None:
            left = int(line)
        elif left > 0:
            left -= 1
            if section == "TIME":
                catalog.times.append(line)
                continue
            first, second, third = (x.strip() for x in line.split(":", 2))
            if section == "MESH":
                catalog.meshes.append((first, second, third))
            elif section:
                catalog.variables[section][first] = (second, third)
    return catalog


def read(path: str) -> Catalog:
    with open(path) as lines:
        catalog = parse(lines.read())
    if not os.path.isabs(catalog.workdir):
        catalog.workdir = os.path.join(os.path.dirname(os.path.abspath(path)), catalog.workdir)
    return catalog


def render(catalog: Catalog) -> str:
    out = ["# Dataset description", "WRKDIR", catalog.workdir, "", "MESH", str(len(catalog.meshes))]
    out += [" : ".join(m) for m in catalog.meshes]
    for family in FAMILIES:
        items = catalog.variables.get(family, {})
        out += ["", family, str(len(items)), *(f"{n} : {v} : {p}" for n, (v, p) in items.items())]
    return "\n".join([*out, "", "TIME", str(len(catalog.times)), *catalog.times, ""])


def generate(workdir: str, formats: dict[str, str], meshes: list[tuple[str, str, str]], reference: str) -> Catalog:
    """A catalog of the files found: formats has a path for each family, like "PHYS/ave.%s.%s.nc".

    Times are the second dot field of the reference variable's files; a family's variables are the third dot
    field of the files of the first time. Families without files are empty.
    """
    catalog = Catalog(workdir, meshes)
    for family, fmt in formats.items():
        found = sorted(os.path.basename(p) for p in glob.glob(os.path.join(workdir, fmt % ("*", reference))))
        times = [name.split(".")[1] for name in found]
        catalog.times = catalog.times or times
    for family, fmt in formats.items():
        for path in sorted(glob.glob(os.path.join(workdir, fmt % (catalog.times[0] if catalog.times else "*", "*")))):
            name = os.path.basename(path).split(".")[2]
            catalog.variables[family][name] = (name, fmt % ("*", name))
    return catalog
