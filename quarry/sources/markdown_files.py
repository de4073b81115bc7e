"""A data source that writes one .md file for each row, from the tasks.

A task writes its files to a folder of its own inside a folder of the job, then a list of their names, then moves them to
their place. When the job ends its folder goes; when the job fails, the lists tell which files go first. So no
row passes the driver, which only reads lists, one at a time, and only after a failure.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path, from a URI or a local path."""
    files, at = fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")
    return files, at.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    n: int


class MarkdownFiles(DataSource):
    """Rows of name and text; option path is the folder. Files of equal names replace each other."""

    @classmethod
    def name(cls) -> str:
        return "markdown_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite):
        return MarkdownWriter(self.options["path"])


class MarkdownWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder
        self.job = f"_job-{uuid.uuid4().hex}"

    def write(self, rows):
        files, top = located(self.folder)
        task = uuid.uuid4().hex
        staged, names = f"{top}/{self.job}/{task}", []
        files.create_dir(staged)
        try:
            for row in rows:
                with files.open_output_stream(f"{staged}/{row['name']}.md") as out:
                    out.write(row["text"].encode())
                names.append(row["name"])
        except BaseException:
            files.delete_dir(staged)
            raise
        with files.open_output_stream(f"{top}/{self.job}/{task}.json") as out:
            out.write(json.dumps(names).encode())
        for name in dict.fromkeys(names):
            files.move(f"{staged}/{name}.md", f"{top}/{name}.md")
        files.delete_dir(staged)
        return Written(len(names))

    def _lists(self, files: fs.FileSystem, top: str) -> list[str]:
        found = files.get_file_info(fs.FileSelector(f"{top}/{self.job}", allow_not_found=True))
        return [f.path for f in found if f.path.endswith(".json")]

    def commit(self, messages):
        files, top = located(self.folder)
        if files.get_file_info(f"{top}/{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{top}/{self.job}")

    def abort(self, messages):
        """No file of the job stays; one that it replaced is gone too."""
        files, top = located(self.folder)
        for listed in self._lists(files, top):
            with files.open_input_stream(listed) as held:
                for name in json.loads(held.read()):
                    if files.get_file_info(f"{top}/{name}.md").type != fs.FileType.NotFound:
                        files.delete_file(f"{top}/{name}.md")
        self.commit(messages)
