from voxelloom.cli import main

raise SystemExit(main())
