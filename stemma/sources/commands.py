"""Build commands to files: which output a command line makes, and from which inputs and libraries.

One table function reads a captured command (pid, pwd, rootdir, prog, argv) and
gives candidate files with their roles; a catalog of existing files (path,
blob) then decides which of them count.  A family of commands is a row of
``FAMILIES``: the options that take a value, the option that names the output,
and where its inputs stand.  What a family cannot say in such a row has a
function of its own.
"""

from __future__ import annotations

import os.path
import re
import shlex
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.plans.storage import numbered


@dataclass
class Family:
    """How a command's line is read."""

    programs: str  # a pattern over the base name
    takes_value: frozenset = field(default_factory=frozenset)
    output: str = "-o"
    inputs: str = r".*"  # which words are files
    same_file: bool = False  # works on its last file in place
    default_output: str = ""


_CC_VALUES = frozenset(
    "-o -I -L -l -include -imacros -isystem -iquote -idirafter -isysroot -MF -MT -MQ -x -T -u -z -e -h -G -D -U -A -Xlinker -Xpreprocessor -Xassembler -Xclang "
    "-arch -target -aux-info -dumpbase -dumpdir -param --param -main-file-name -mrelocation-model -mthread-model -target-cpu -triple -resource-dir -fdebug-compilation-dir -coverage-notes-file -internal-isystem -internal-externc-isystem -ferror-limit".split()
)
_LD_VALUES = frozenset("-o -m -e -h -soname -T -L -l -z -u -R -rpath -rpath-link -dynamic-linker -plugin -Map -A -b -c -F -f -G -I -O -y -Y --sysroot --version-script --dynamic-list".split())

#: Programs by family, with the options that take a value.
FAMILIES = {
    "cc": Family(r"(?:.*-)?(?:gcc|g\+\+|cc|c\+\+|clang|clang\+\+)(?:-[\d.]+)?", _CC_VALUES, inputs=r".*\.(?:c|C|cc|cpp|cxx|c\+\+|i|ii|m|s|S|sx|o|lo|a|so(?:\.[\d.]+)?|h|hpp)$", default_output="a.out"),
    "ld": Family(r"(?:.*-)?(?:ld|ld\.bfd|ld\.gold|ld\.lld|lld)", _LD_VALUES, inputs=r".*\.(?:o|lo|a|so(?:\.[\d.]+)?|bc)$", default_output="a.out"),
    "rustc": Family(r"rustc", frozenset("-o --crate-name --crate-type --edition --emit -C --out-dir -L -l --extern --cfg --cap-lints --target --sysroot --error-format --json".split()), inputs=r".*\.rs$"),
    "go": Family(r"compile|link|asm", frozenset("-o -trimpath -p -buildid -importcfg -goversion -D -symabis -embedcfg -buildmode -extld -I -lang -c".split()), inputs=r".*\.(?:go|a|s|o)$"),
    "javac": Family(r"javac", frozenset("-d -cp -classpath -sourcepath -source -target -encoding --release -h -s -processorpath".split()), output="-d", inputs=r".*\.java$"),
    "strip": Family(r"(?:.*-)?(?:strip|eu-strip|dwz|rpmsign|chrpath)", frozenset("-o -f -F -m -r -K -N -R -l -L -M --remove-section --keep-symbol -I -O --define --key-id".split()), same_file=True),
    "same": Family(r"(?:.*-)?(?:ranlib|objtool|debugedit|sorttable|resolve_btfids|sepdebugcrcfix)", frozenset("-b -d -i -l --base-dir --dest-dir".split()), same_file=True),
}

#: What a compiler line says when it stops before linking.
STOPS_EARLY = (" -c ", " -S ", " -E ", " -cc1 ")


def words_of(argv: str) -> list[str]:
    try:
        return shlex.split(argv)
    except ValueError:
        return argv.split()


def _read(family: Family, words: list[str]) -> tuple[list[str], list[str]]:
    """Outputs and plain words of a line."""
    outs, plain, k = [], [], 0
    while k < len(words):
        w = words[k]
        if w == family.output and k + 1 < len(words):
            outs.append(words[k + 1])
            k += 1
        elif w in family.takes_value:
            k += 1
        elif family.output == "-o" and w.startswith("-o") and len(w) > 2 and not w.startswith("--"):
            outs.append(w[2:])
        elif w.startswith("--output="):
            outs.append(w.partition("=")[2])
        elif not w.startswith("-"):
            plain.append(w)
        k += 1
    return outs, plain


def _libraries(words: list[str]) -> tuple[list[str], list[str]]:
    """Names after ``-l`` and folders after ``-L``, attached or apart."""
    found: dict[str, list[str]] = {"-l": [], "-L": []}
    for k, w in enumerate(words):
        if w[:2] in found:
            value = w[2:] or (words[k + 1] if k + 1 < len(words) else "")
            if value:
                found[w[:2]].append(value)
    return found["-l"], found["-L"]


def _compiled(words: list[str], argv: str):
    family = FAMILIES["cc"]
    outs, plain = _read(family, words)
    files = [w for w in plain if re.match(family.inputs, w)]
    early = any(s in f" {argv} " for s in STOPS_EARLY)
    if not outs and early:
        if " -E " in f" {argv} ":
            return [], files
        # One output for each source, in the working folder.
        end = ".s" if " -S " in f" {argv} " else ".o"
        return [os.path.splitext(os.path.basename(f))[0] + end for f in files], files
    return outs or [family.default_output], files


def _archived(words: list[str]):
    """``ar`` with its operation, modifiers that take a word, the archive and its members."""
    plain = [w for w in words if not (w.startswith("--") or w in ("-X32_64",))]
    if len(plain) < 2 or not set("rqs") & set(plain[0].lstrip("-")):
        return [], []
    skip = 1 + any(c in plain[0] for c in "abiN")
    return plain[skip : skip + 1], plain[skip + 1 :]


@dataclass
class Patch:
    """What a ``patch`` line says."""

    target: str = ""
    patch: str = ""
    output: str = ""
    folder: str = ""
    strip: int | None = None


def patch_line(words: list[str]) -> Patch:
    """The patch, where it comes from and how many folders its names lose."""
    told, plain, k = Patch(), [], 0
    long = {"--input": "-i", "--output": "-o", "--directory": "-d", "--strip": "-p"}
    while k < len(words):
        w = words[k]
        name, given, value = w.partition("=")
        if name in long and (given or k + 1 < len(words)):
            option, value, k = long[name], value if given else words[k + 1], k if given else k + 1
        elif w[:2] in ("-i", "-o", "-d", "-p") and not w.startswith("--"):
            option, value, k = (w[:2], w[2:], k) if len(w) > 2 else (w, words[k + 1] if k + 1 < len(words) else "", k + 1)
        elif w in ("-F", "-B", "-r", "-D", "-V", "-z", "-Y", "-g"):
            k += 2
            continue
        elif w == "<" or w.startswith("<"):
            option, value, k = ("-i", words[k + 1] if k + 1 < len(words) else "", k + 1) if w == "<" else ("-i", w[1:], k)
        else:
            if not w.startswith("-"):
                plain.append(w)
            k += 1
            continue
        if option == "-p":
            told.strip = int(value) if value.isdigit() else None
        else:
            setattr(told, {"-i": "patch", "-o": "output", "-d": "folder"}[option], value)
        k += 1
    told.target = plain[0] if plain else ""
    told.patch = told.patch or (plain[1] if len(plain) > 1 else "")
    return told


def _patched(words: list[str]):
    """``patch``: the file it changes, if named, and the patch; without a name the patch tells the files."""
    told = patch_line(words)
    at = lambda f: os.path.join(told.folder, f) if told.folder and f else f
    target = at(told.output or told.target)
    return [target] if target else [], [x for x in (at(told.target), told.patch) if x]


def _installed(words: list[str]):
    """``install``: each file and its copy, in a folder if there are several or ``-t`` names one."""
    folder, plain, k = "", [], 0
    while k < len(words):
        w = words[k]
        if w in ("-d", "--directory"):
            return [], []
        if w in ("-t", "--target-directory") and k + 1 < len(words):
            folder, k = words[k + 1], k + 1
        elif w.startswith("--target-directory="):
            folder = w.partition("=")[2]
        elif w in ("-m", "-o", "-g", "-S", "--mode", "--owner", "--group", "--suffix"):
            k += 1
        elif not w.startswith("-"):
            plain.append(w)
        elif not w.startswith("--") and "d" in w:
            return [], []
        k += 1
    if not folder and (len(plain) > 2 or len(plain) == 2 and plain[1].endswith("/")):
        folder = plain.pop()
    if folder:
        return [os.path.join(folder, os.path.basename(f)) for f in plain], plain
    return (plain[1:], plain[:1]) if len(plain) == 2 else ([], [])


def parse(prog: str, argv: str) -> tuple[str, list[str], list[str], list[str], list[str]]:
    """Family, outputs, inputs, library names and library folders of one command; no family for others."""
    name = os.path.basename(prog)
    words = words_of(argv)[1:]
    if re.fullmatch(r"(?:.*-)?(?:gcc-)?ar", name):
        return ("ar", *_archived(words), [], [])
    if name == "patch":
        return ("patch", *_patched(words), [], [])
    if name == "jar":
        short = words[0].lstrip("-") if words else ""
        if "c" not in short and "u" not in short:
            return "jar", [], [], [], []
        skip = [w for w in words[1:] if not w.startswith("-")]
        files = skip[1 + ("m" in short) :]
        return "jar", skip[:1], [f for f in files if f != "."], [], []
    if re.fullmatch(r"(?:.*-)?objcopy", name):
        _, plain = _read(Family(name, frozenset("-I -O -B -j -R -K -N -L -W -F --add-section --remove-section --set-section-flags --add-gnu-debuglink --only-section".split())), words)
        return ("objcopy", plain[1:2] or plain[:1], plain[:1], [], []) if plain else ("objcopy", [], [], [], [])
    if name == "install":
        return ("install", *_installed(words), [], [])
    if name == "sign-file":
        plain = [w for w in words if not w.startswith("-")]
        module = plain[3:5]
        return "sign-file", [module[-1]] if module else [], module[:1], [], []
    if name == "bzImage" or name == "build" and "bzImage" in argv:
        plain = [w for w in words if not w.startswith("-") and w != "CURRENT"]
        return "bzimage", plain[-1:], plain[:-1], [], []
    if name == "dpkg-deb":
        plain = [w for w in words if not w.startswith("-")]
        return ("package", plain[1:2], plain[:1], [], []) if any(w in ("-b", "--build") for w in words) else ("package", [], [], [], [])
    if name in ("rpmbuild", "rpmbuild-ng"):
        return "package", [w for w in words if w.endswith(".rpm")], [w for w in words if w.endswith(".spec")], [], []
    for kind, family in FAMILIES.items():
        if not re.fullmatch(family.programs, name):
            continue
        libs, folders = _libraries(words) if kind in ("cc", "ld", "rustc") else ([], [])
        if kind == "cc":
            outs, ins = _compiled(words, argv)
            return kind, outs, ins, libs, folders
        outs, plain = _read(family, words)
        if family.same_file:
            return kind, outs or plain[-1:], plain[-1:], [], []
        ins = [w for w in plain if re.match(family.inputs, w)]
        if kind == "rustc" and not outs:
            named = dict(zip(words, words[1:]))
            outs = [os.path.join(named.get("--out-dir", "."), ("lib%s.rlib" if named.get("--crate-type") == "lib" else "%s") % named["--crate-name"])] if "--crate-name" in named else []
        if kind == "rustc":
            ins += [w.partition("=")[2] for k, w in enumerate(words) if k and words[k - 1] == "--extern" and "=" in w]
        if kind == "javac":
            base = outs[0] if outs else ""
            outs = [os.path.join(base, os.path.splitext(i)[0] + ".class") if base else os.path.splitext(i)[0] + ".class" for i in ins]
        return kind, outs or ([family.default_output] if family.default_output else []), ins, libs, folders
    return "", [], [], [], []


def real_path(path: str, pwd: str, root: str = "") -> str:
    full = os.path.normpath(os.path.join(pwd or "/", path))
    return os.path.join(root, full.lstrip("/")) if root and root != "/" else full


_OUT = "cmd_id long, family string, role string, pos int, path string"
_SCHEMA = pa.schema([("cmd_id", pa.int64()), ("family", pa.string()), ("role", pa.string()), ("pos", pa.int32()), ("path", pa.string())])

#: Families whose outputs each have the input of their own place, if there are several.
ONE_BY_ONE = ("cc", "install", "javac")


def _lists(family: str, words: list[str]) -> list[str]:
    """Files that a line names and that list further inputs or outputs."""
    if family == "patch":
        told = patch_line(words)
        return [] if told.target or told.output or not told.patch else [told.patch]
    if family == "go":
        return [w.partition("=")[2] if "=" in w else words[k + 1] for k, w in enumerate(words) if w.lstrip("-").partition("=")[0] == "importcfg" and ("=" in w or k + 1 < len(words))]
    return []


def command_files(commands: DataFrame) -> DataFrame:
    """(cmd_id, family, role, pos, path) of commands (cmd_id, pwd, rootdir, prog, argv).

    Roles are ``out``, ``in``, ``lib`` and ``list``; a library has a candidate
    path for each folder it may lie in, in order, and a list is a file whose
    text names further files, as patches and import tables do.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for cmd, pwd, root, prog, argv in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                family, outs, ins, libs, folders = parse(prog or "", argv or "")
                at = lambda p: real_path(p, pwd or "/", root or "")  # noqa: E731,B023
                rows += [(cmd, family, "out", k, at(p)) for k, p in enumerate(outs)] + [(cmd, family, "in", k, at(p)) for k, p in enumerate(ins)]
                rows += [(cmd, family, "lib", k, at(os.path.join(f, f"lib{n}{end}"))) for k, (n, f, end) in enumerate((n, f, end) for n in libs for f in folders for end in (".so", ".a"))]
                rows += [(cmd, family, "list", k, at(p)) for k, p in enumerate(_lists(family, words_of(argv or "")[1:]))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return commands.select("cmd_id", "pwd", "rootdir", "prog", "argv").mapInArrow(run, _OUT)


def with_responses(commands: DataFrame, responses: DataFrame) -> DataFrame:
    """Commands whose ``@file`` words give way to the words of that file, from responses (path, text); others stay as they are."""
    word = r"(?:^|(?<=\s))@(\S+)"
    asked = commands.select("cmd_id", "pwd", F.explode(F.array_distinct(F.regexp_extract_all("argv", F.lit(word), F.lit(1)))).alias("__name"))
    place = F.when(F.startswith("__name", F.lit("/")), F.col("__name")).otherwise(F.concat(F.rtrim("pwd", F.lit("/")), F.lit("/"), F.regexp_replace("__name", r"^\./", "")))
    found = asked.withColumn("path", place).join(responses.select("path", "text"), "path")
    lists = found.groupBy("cmd_id").agg(F.array_sort(F.collect_list(F.struct("__name", F.regexp_replace(F.btrim("text", F.lit(" \t\r\n")), r"\s*\n\s*", " ").alias("words")))).alias("__found"))
    spaced = F.concat(F.lit(" "), F.col("argv"), F.lit(" "))
    filled = F.aggregate("__found", spaced, lambda line, f: F.replace(line, F.concat(F.lit(" @"), f["__name"], F.lit(" ")), F.concat(F.lit(" "), f["words"], F.lit(" "))))
    joined = commands.join(lists, "cmd_id", "left")
    return joined.withColumn("argv", F.when(F.col("__found").isNotNull(), F.btrim(filled, F.lit(" "))).otherwise(F.col("argv"))).select(*commands.columns)


def patched_files(commands: DataFrame, patches: DataFrame) -> DataFrame:
    """(cmd_id, family, role, pos, path): what patch commands change, told by their patches (file, targets).

    ``targets`` are the names as the patch has them; ``-p`` says how many
    folders they lose, and without it all.  Each file is an output, and an
    input as it was; the patch itself is the last input.
    """
    lines = command_files(commands).filter("family = 'patch' AND role = 'list'").select("cmd_id", F.col("path").alias("file"))

    @F.udf("array<string>", useArrow=True)
    def places(argv, pwd, root, targets):
        told = patch_line(words_of(argv or "")[1:])
        cut = lambda t: t.rsplit("/", 1)[-1] if told.strip is None else "/".join(t.split("/")[told.strip :])
        return [real_path(os.path.join(told.folder, cut(t)), pwd or "/", root or "") for t in targets]

    listed = lines.join(patches.select("file", "targets"), "file").join(commands.select("cmd_id", "argv", "pwd", "rootdir"), "cmd_id")
    listed = listed.select("cmd_id", "file", places("argv", "pwd", "rootdir", "targets").alias("paths"))
    changed = listed.select("cmd_id", F.posexplode("paths").alias("pos", "path"))
    row = lambda df, role, pos, path: df.select("cmd_id", F.lit("patch").alias("family"), F.lit(role).alias("role"), pos.cast("int").alias("pos"), path.alias("path"))
    return row(changed, "out", F.col("pos"), F.col("path")).unionByName(row(changed, "in", F.col("pos"), F.col("path")))


def imported_files(commands: DataFrame, tables: DataFrame) -> DataFrame:
    """(cmd_id, family, role, pos, path): the packages that import tables (file, text) name, as inputs behind a command's own."""
    lines = command_files(commands).filter("family = 'go' AND role = 'list'").select("cmd_id", F.col("path").alias("file"))
    named = tables.select("file", F.regexp_extract_all("text", F.lit(r"(?m)^packagefile [^=\n]+=(\S+)$"), F.lit(1)).alias("paths"))
    found = lines.join(named, "file").select("cmd_id", F.posexplode("paths").alias("pos", "path"))
    return found.select("cmd_id", F.lit("go").alias("family"), F.lit("in").alias("role"), (F.col("pos") + F.lit(1 << 20)).alias("pos"), "path")


def command_records(commands: DataFrame, catalog: DataFrame, headers: DataFrame | None = None, listed: DataFrame | None = None) -> DataFrame:
    """Build records (``stemma.sources.schemas.RECORD``) of commands whose files a catalog (path, blob) knows.

    One record for each existing output, with the existing inputs; records are
    numbered by command and output.  A linker that a compiler ran on is marked
    information only.  ``headers(cmd_id, path)`` adds what dependency files
    list, behind all other inputs; ``listed`` adds rows of ``command_files``
    that other files tell, such as patches.
    """
    files = command_files(commands).filter("role <> 'list'")
    if listed is not None:
        files = files.unionByName(listed.select(*files.columns))
    files = files.withColumn("rank", F.lit(0))
    if headers is not None:
        families = files.select("cmd_id", "family").distinct()
        files = files.unionByName(headers.join(families, "cmd_id").select("cmd_id", "family", F.lit("in").alias("role"), F.lit(-1).alias("pos"), "path", F.lit(1).alias("rank")))
    known = files.join(catalog.select("path", "blob"), "path")
    outs = known.filter("role = 'out'").select("cmd_id", "family", F.col("pos").alias("out_pos"), F.col("blob").alias("out_blob"), F.col("path").alias("out_path"))
    several = files.filter("role = 'out'").groupBy("cmd_id").agg((F.count(F.lit(1)) > 1).alias("several"))
    entry = F.struct("rank", "pos", "path", "blob")
    lists = known.groupBy("cmd_id").agg(F.array_sort(F.collect_set(F.when(F.col("role") == "in", entry))).alias("ins"), F.array_sort(F.collect_set(F.when(F.col("role") == "lib", entry))).alias("libs"))
    none = F.array().cast("array<string>")
    # A compiler's or installer's file of another place has nothing to do with this one; headers have to do with all.
    own = F.filter("ins", lambda f: ~(F.col("family").isin(*ONE_BY_ONE) & F.col("several")) | (f["pos"] == F.col("out_pos")) | (f["rank"] > 0))
    infiles = F.transform("own", lambda f, k: F.struct(k.cast("int").alias("pos"), f["blob"].alias("blob"), f["path"].alias("path"), none.alias("has_cve"), none.alias("fixed_cve"), F.lit(None).cast("string").alias("prov_pkg")))
    dynlibs = F.transform("libs", lambda f: F.struct(f["pos"].alias("pos"), f["blob"].alias("blob"), f["path"].alias("path")))
    early = F.exists(F.array(*[F.contains(F.concat(F.lit(" "), F.col("argv"), F.lit(" ")), F.lit(s)) for s in STOPS_EARLY]), lambda x: x)
    only_links = (F.col("family") == "cc") & ~early & ~F.exists("ins", lambda f: f["path"].rlike(r"\.(c|C|cc|cpp|cxx|s|S)$"))
    joined = outs.join(lists, "cmd_id").join(several, "cmd_id").join(commands.select("cmd_id", "pid", "prog", "argv"), "cmd_id").withColumn("own", own)
    return numbered(joined, ["cmd_id", "out_pos"], "seq").select(
        "seq", "pid", F.lit(None).cast("string").alias("exec_mode"), "out_blob", "out_path", F.col("argv").alias("build_cmd"), F.col("prog").alias("build_tool"),
        F.lit(None).cast("string").alias("pkg_info"), F.lit(None).cast("string").alias("prune"), only_links.alias("ignore"), infiles.alias("infiles"), dynlibs.alias("dynlibs"),
    )


def watched(commands: DataFrame, programs: list[str]) -> DataFrame:
    """Commands of programs on a watch list: a full path, a base name, or ``-suffix`` for the end of a base name."""
    name = F.element_at(F.split("prog", "/"), -1)
    full, base, ends = [p for p in programs if "/" in p], [p for p in programs if "/" not in p and not p.startswith("-")], [p for p in programs if p.startswith("-")]
    hit = F.col("prog").isin(full) | name.isin(base)
    for end in ends:
        hit = hit | name.endswith(end)
    return commands.filter(hit)


def read_watch_list(text: str) -> dict[str, list[str]]:
    """Programs by mode from a list with its separators; comments and blank lines are skipped."""
    modes = {"---": "pre_exec", "===": "detach", "+++": "umbrella"}
    out: dict[str, list[str]] = {"watched": [], **{m: [] for m in modes.values()}}
    mode = "watched"
    for line in map(str.strip, text.splitlines()):
        if line in modes:
            mode = modes[line]
        elif line and not line.startswith("#"):
            out[mode].append(line)
    return out
