from wayweft.cli import main

raise SystemExit(main())
