"""Files on the driver: paths, downloads, archives."""

from __future__ import annotations

import os
import shutil
import tarfile
import urllib.request
import zipfile
from pathlib import Path


def to_path(path: str | Path) -> Path:
    if isinstance(path, (str, Path)):
        return Path(path)
    raise TypeError("a path is a string or a Path")


def download_file(url: str, filename: str | None = None, dirpath: str | Path = ".", force: bool = False) -> str:
    """Fetches a file; returns its path, or "" if it is there already and not forced."""
    target = to_path(dirpath).resolve() / (filename or url.rstrip("/").rpartition("/")[2].partition("?")[0])
    if target.is_file() and not force:
        return ""
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    try:
        with urllib.request.urlopen(urllib.request.Request(url)) as response, part.open("wb") as out:
            shutil.copyfileobj(response, out)
        part.replace(target)
    except Exception as e:
        part.unlink(missing_ok=True)
        raise RuntimeError(f"{url} can't be fetched") from e
    return str(target)


def _members(archive: Path) -> list[str] | None:
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            return z.namelist()
    if tarfile.is_tarfile(archive):
        with tarfile.open(archive) as t:
            return t.getnames()
    return None


def extract_archive(archive_file: str | Path, extract_dir: str | Path | None = None) -> str:
    """Unpacks a ZIP or TAR; members under one root get the archive's name (without endings) as that root.

    Returns the folder with the files; of a file that is no archive, the folder it would have gone to.
    """
    archive = to_path(archive_file).resolve()
    folder = to_path(extract_dir) if extract_dir else archive.parent
    folder.mkdir(parents=True, exist_ok=True)
    members = _members(archive)
    if members is None:
        print(f"{archive} is not a ZIP or TAR archive")
        return str(folder)
    kind = "zip" if zipfile.is_zipfile(archive) else None
    if kind:
        shutil.unpack_archive(archive, folder, kind)
    else:
        with tarfile.open(archive) as t:
            t.extractall(folder, filter="data")
    root = os.path.commonpath(members).split("/")[0] if members else ""
    if not root:
        return str(folder)
    name = archive.name.split(".")[0] or archive.name
    if name == root:
        return str(folder / root)
    shutil.move(folder / root, folder / name)
    return str(folder / name)
