"""What the tests share by name; ``conftest`` is no module to import from, as each folder may have one."""

SF_DIR = "/root/testdata/sf0.001"
